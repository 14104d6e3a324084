"""Spark-native cleaning and summarising of ion-mobility point clouds."""
