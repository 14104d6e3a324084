"""BPE encoding and decoding with an index of pair occurrences.

All distinct words of a batch lie in one array of symbols. The index maps each mergeable pair to all its places there;
active pairs are applied in ascending rank, at all their places at once, and only the lists of the pairs beside a
merge are updated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ionsift.llm.common import tidy

END = "</w>"
SHIFT = 1 << 20
NO_RANK = np.int32(2**31 - 1)
#: A vocabulary file is broadcast; this bounds it.
MOST_BYTES = 64 << 20
#: Texts are encoded in groups of about so many characters; a group's words and arrays are what a worker holds, and keeps
#: in part until it ends.
GROUP = 1 << 22


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(free))
        free += b not in shown
    return out


class Bpe:
    """A tokenizer file whose model is BPE with word ends, over NFC, lower case and single blanks."""

    def __init__(self, source: str):
        import regex

        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or spec.get("decoder") is not None:
            raise ValueError("the file must hold BPE with word ends and no decoder")
        vocab = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = {i: t.encode() for i, t in self.tokens.items()}
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.final = np.array([vocab[c + END] for c in alphabet], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        code = self.left.astype(np.int64) * SHIFT + self.right
        self.rank_order = np.argsort(code).astype(np.int32)
        self.codes = code[self.rank_order]
        pretokens = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pretokens.replace(r"\s", r"\p{White_Space}")).findall
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a.astype(np.int64) * SHIFT + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (a >= 0) & (b >= 0), self.rank_order[at], NO_RANK)

    def split(self, text: str) -> list[str]:
        """Words of a text as the model sees them; special tokens stand whole. White space only divides words."""
        if not any(s in text for s in self.special):
            return self.words(normalize("NFC", text).replace("Σ", "σ").lower())
        out: list[str] = []
        for piece in self.cuts.split(text):
            if piece in self.special:
                out.append(piece)
            elif piece:
                out += self.words(normalize("NFC", piece).replace("Σ", "σ").lower())
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and each word's bounds."""
        raw = [w.encode() for w in words]
        size = np.fromiter((len(x) for x in raw), np.int64, len(raw))
        bounds = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        symbols[bounds[1:] - 1] = self.final[data[bounds[1:] - 1]]
        alive = self.merge(symbols, bounds)
        return symbols[alive], np.concatenate([[0], np.cumsum(alive)])[bounds]

    def merge(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Applies all merges to ``symbols`` in place; which places still hold a symbol."""
        n = len(symbols)
        sym = np.append(symbols, np.int32(-1))  # place n stands for "none"
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[bounds[1:] - 1] = n
        before[bounds[:-1]] = n
        alive = np.ones(n, bool)
        rank = self.ranks(sym[:n], sym[after[:n]])
        index: dict[int, list[np.ndarray]] = {}

        def add(rank: np.ndarray, place: np.ndarray) -> list[int]:
            keep = rank != NO_RANK
            if not keep.any():
                return []
            rank, place = rank[keep], place[keep]
            order = np.argsort(rank, kind="stable")
            rank, place = rank[order], place[order]
            cut = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            new = []
            for r, group in zip(rank[cut].tolist(), np.split(place, cut[1:]), strict=True):
                if r in index:
                    index[r].append(group)
                else:
                    index[r] = [group]
                    new.append(r)
            return new

        active = add(rank, np.arange(n))
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            a, b, made = self.left[r], self.right[r], self.made[r]
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            q = after[p]
            p = p[(sym[p] == a) & (sym[q] == b) & alive[p]]
            if not len(p):
                continue
            if a == b:  # within a run of equal symbols every second place
                chained = np.r_[False, after[p[:-1]] == p[1:]]
                i = np.arange(len(p))
                p = p[(i - np.maximum.accumulate(np.where(chained, 0, i))) % 2 == 0]
            q = after[p]
            far = after[q]
            sym[p] = made
            sym[q] = -1
            alive[q] = False
            after[p] = far
            inside = far < n
            before[far[inside]] = p[inside]
            near = before[p]
            for new in (add(self.ranks(sym[near], sym[p]), near), add(self.ranks(sym[p], sym[far]), p)):
                for x in new:
                    heapq.heappush(active, x)
        symbols[:] = sym[:n]
        return alive

    def decode(self, ids) -> bytes:
        """Tokens joined by blanks, as the library does for a file without a decoder; special tokens stay."""
        return b" ".join([self.token_bytes[i] for i in ids])

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[bytes], list[bytes]]]:
        """For each text the ids of its words (little-endian, 32 bits) and their decoded forms."""
        seen: dict[str, int] = {}
        docs = [[seen.setdefault(w, len(seen)) for w in self.split(t)] for t in texts]
        words = list(seen)
        plain = [w for w in words if w not in self.special]
        ids, cut = self.encode_words(plain) if plain else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        flat, cuts = ids.tolist(), cut.tolist()
        raw = ids.astype("<u4").tobytes()
        made = {w: (raw[4 * b : 4 * e], self.decode(flat[b:e])) for w, b, e in zip(plain, cuts[:-1], cuts[1:], strict=True)}
        made |= {w: (np.array([i], "<u4").tobytes(), self.decode([i])) for w, i in self.special.items()}
        coded, shown = [made[w][0] for w in words], [made[w][1] for w in words]
        for d in docs:
            yield [coded[i] for i in d], [shown[i] for i in d]


@lru_cache(maxsize=2)
def _loaded(source: str) -> Bpe:
    return Bpe(source)


def _rows(source, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(source.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) <= GROUP):
                    size += len(texts[end])
                    end += 1
                n, digest, back_digest, ids, back = [], [], [], [], []
                for coded, shown in coder.encode_all(texts[begin:end]):
                    raw, text = b"".join(coded), b" ".join(shown)
                    n.append(len(raw) // 4)
                    digest.append(hashlib.sha256(raw).hexdigest())
                    back_digest.append(hashlib.sha256(text).hexdigest())
                    ids.append(np.frombuffer(raw, "<u4").astype(np.int32) if full else None)
                    back.append(text.decode() if full else None)
                yield pa.record_batch([batch.column("doc_id").slice(begin, end - begin), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back_digest, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])
                begin = end

    return run


def encode(docs: DataFrame, path: str, full: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded`` for each row of ``docs`` (``doc_id, text``).

    ``path`` names the tokenizer file on the driver. Null texts count as empty; empty ones have no ids. ``ids`` and
    ``decoded`` are null unless ``full``. Rows and repeats stay, null ids too; other columns are not carried. No shuffle.
    """
    source = Path(path).read_text()
    if len(source) > MOST_BYTES:
        raise ValueError(f"a vocabulary of over {MOST_BYTES} bytes is not broadcast")
    sent = docs.sparkSession.sparkContext.broadcast(source)
    return docs.select("doc_id", "text").mapInArrow(tidy(_rows(sent, full)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")
