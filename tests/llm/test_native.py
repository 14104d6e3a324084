"""URL filters, chat formatting and personal data."""

import random
import re

from pyspark.sql import functions as F

from ionsift.llm import chat, pii, url_filter


def test_urls(spark):
    rows = [
        (1, "http://A.Example.com/en/725?q"), (2, "http://example.com/en/8"), (3, "x://net/de/"), (4, None), (5, "no scheme/en/"),
        (6, "http://my-net/de/1"), (7, "http://a.example.net/de/85#x"), (8, "http://b.org/es"), (9, "http://b.org?/es/"), (10, ""), (11, "http://ads.x.fr/a"), (1, "http://A.Example.com/en/725?q"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect())
    assert got[0] == got[1] == (1, "a.example.com", "/en/725", "example.com/en/7", "allow")
    by = {g[0]: g[1:] for g in got}
    assert by[2] == ("example.com", "/en/8", "com/en/", "block") and by[3] == ("net", "/de/", "net/de/", "allow")
    assert by[4] == by[5] == by[10] == ("", "", None, "allow")
    assert by[6] == ("my-net", "/de/1", None, "allow") and by[7][2:] == ("example.net/de/8", "block")
    assert by[8][2] is None and by[9][1:] == ("", None, "allow") and by[11][3] == "block"
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_pattern_rules_need_their_tokens(spark):
    """Each URL that a pattern fits is blocked, whichever of the pattern's forms it has."""
    fit = ["http://ad.x.fr/", "http://ads.x.fr/", "http://ads2.x.fr/a", "http://b.AD17.x.fr/", "http://x.fr/a.ads7.b/c", "http://x.fr/login", "http://x.fr/signin", "http://x.fr/a/signin/b?q", "http://x.fr/cgi-bin/a.exe"]
    free = ["http://ad.x.fr", "http://adx.x.fr/", "http://ads2x.x.fr/", "http://x.fr/signing", "http://x.fr/my-login", "http://signin.x.fr/"]
    df = spark.createDataFrame(list(enumerate(fit + free)), "page_id long, url string")
    got = {r.url: r.verdict for r in url_filter.judge_urls(df).collect()}
    assert got == {u: "block" for u in fit} | {u: "allow" for u in free}


def test_urls_against_all_rules(spark, monkeypatch):
    """Every rule on every URL, in the plan and as a table; long URLs and rules without a token among them."""
    r = random.Random(12)
    bits = ["a", "ad", "ads", "ads7", "ad12", "login", "signin", "en", "de", "es", "casino", "spam-farm", "free-bets", "x", "example", "com", "net", "org", "cgi-bin", "f.exe", "f.dll", "7", "8", "-", "adult"]
    urls = []
    for _ in range(800):
        host = ".".join(r.choice(bits).replace("/", "") for _ in range(r.randint(1, 4)))
        path = "".join("/" + r.choice(bits) + r.choice(["", r.choice(bits)]) for _ in range(r.randint(0, 4)))
        urls.append(f"http://{host}{path}{r.choice(['', '/', '?q=/login', '#/signin', chr(10)])}")
    urls += ["http://x.org/" + "a/" * 20_000 + "login", "http://" + "b." * 20_000 + "ads.c/", "http://a.org/" + "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_filter.SITE_RULES + url_filter.PATTERN_RULES

    def brute(url):
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        text = host.lower() + path
        fits = [x for x in rules if re.search(x.pattern.replace(r"\z", r"\Z"), text)]
        site = max((x for x in fits if x.site), key=lambda x: (len(x.name), x.name), default=None)
        return (site.name, site.action) if site else (None, "block" if any(x.action == "block" for x in fits) else "allow")

    want = {i: brute(u) for i, u in enumerate(urls)}
    assert {w[1] for w in want.values() if w[0] is None} == {"allow", "block"}
    assert {x.page_id: (x.rule, x.verdict) for x in url_filter.judge_urls(df).collect()} == want
    monkeypatch.setattr(url_filter, "INLINE", 2)
    assert {x.page_id: (x.rule, x.verdict) for x in url_filter.judge_urls(df, inline=3).collect()} == want


TEXTS = ["", None, "plain", "a\\b<|end|>\n", "<\\|turn|>", "\\<|", "\\\\<\\\\|", "</s>[INST] ok [/INST]", "é😀\n\n", "x" * 50_000]


def test_chat_round_trip(spark):
    rows = [(i % 3, i, "assistant" if i % 2 else "us\ner\\n<|", t) for i, t in enumerate(TEXTS)] + [(None, 0, None, None), (9, 1, "user", "same"), (9, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(1))
    done = chat.format_turns(df.withColumn("content", chat.text_parts(F.col("text")))).withColumn("back", chat.read_turns(F.col("formatted"))).collect()
    assert len(done) == 5
    for r in done:
        want = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: x[1])]
        assert [(t.role, t.text) for t in r.back] == want and r.n_turns == len(want)
        assert r.formatted == "".join(s.text for s in r.segments)
        assert [r.formatted[s.start : s.end] for s in r.loss_spans] == [s.text for s in r.segments if s.loss]
    assert chat.format_turns(df.withColumn("content", chat.text_parts(F.col("text"))).limit(0)).count() == 0


def test_chat_parts(spark):
    df = spark.sql("""SELECT 1L conv_id, 0L turn, 'user' role, array(named_struct('type','text','text','look <|image|>','ref',null,'units',null), named_struct('type','image','text',null,'ref','a.png','units',2.0D),
        named_struct('type','audio','text',null,'ref','b.wav','units',1.5D), named_struct('type','odd','text',null,'ref','c','units',null)) content UNION ALL SELECT 1L, 1L, 'assistant', null""")
    r = chat.format_turns(df.withColumn("content", F.col("content").cast(chat.PARTS))).first()
    assert r.formatted == "<|turn|>user\nlook <\\|image|><|image|><|audio|><|unknown:odd|><|end|>\n<|turn|>assistant\n<|end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 512), ("audio", "b.wav", 38), ("odd", "c", 0)] and r.expanded_tokens == 550


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    """Brute force: the contract's patterns as they stand."""
    text, out = text or "", []
    for kind, pattern in {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items():
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def random_text(r):
    bits = ["a@b.c", "_", "@", ".", "1.2.3.4", "255.255.0255.1", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "  ", "-", " ", "+1 (555) 123-4567", "+49.30.1234567", "x.y@z", "é😀", "12", "0", "\n", "+", "a.b%c+d@e-f.g.h", "(", "word", "5500005555555559"]
    return "".join(r.choice(bits) for _ in range(r.randint(0, 25)))


def test_pii_base(spark):
    r = random.Random(3)
    texts = [random_text(r) for _ in range(1500)] + [None, "", "1 " * 30_000, "a" * 60_000, "a." * 30_000 + "@x", "x@" + "a." * 20_000 + "b", "+1" + "(" * 20_000, "1." * 20_000, "4111111111111111" * 2_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = pii.find_spans(df)
    got = {x.doc_id: (x.b, x.s) for x in found.select("doc_id", pii.as_text(F.col("pii_base")).alias("b"), pii.as_text(F.col("pii_spans")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == base(t), (i, t[:300])
        assert not got[i][0] or set(got[i][0].split(",")) <= set(got[i][1].split(","))
    assert pii.find_spans(df.limit(0)).count() == 0


def test_pii_added_and_redacted(spark):
    rows = [(1, "write to jane (at) mail (dot) org now"), (2, "call me: (555) 123-4567."), (3, "version 10.20.30 of page 555 123 4567"), (4, "bob@x.org or +1 555 123 4567"), (5, None)]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "write to [EMAIL] now", 2: "call me: [PHONE].", 3: rows[2][1], 4: "[EMAIL] or [PHONE]", 5: None}


#: (text, kind of the one added span or None). Written by hand, in forms and wordings other than the training templates'.
HELD = [
    ("You can find Peter under peter.lang (at) uni-bonn (dot) de during term", "email"), ("questions? ask m_ruiz[at]correo.es please", "email"), ("the list owner is listmaster {at} gnu {dot} org", "email"),
    ("Send patches to dev [at] kernel [dot] org with a sign-off", "email"), ("bug reports -> tracker @ openwall . com", "email"), ("Schreiben Sie an info @stadt-ulm.de bis Freitag", "email"),
    ("press@ newsroom.io answers within a day", "email"), ("Escríbeme a ana.gomez at empresa dot com cuando puedas", "email"), ("sales(at)acme.co.uk is read by nobody", "email"), ("To: frank [at] web.de, Subject: hello", "email"),
    ("blocked 203[.]0[.]113[.]77 at the border router", "ip"), ("the C2 sits on 198(.)51(.)100(.)23 since May", "ip"), ("traceroute to 2001:db8:85a3:8d3:1319:8a2e:370:7348 took 9 hops", "ip"), ("listening on fe80:1c2:33aa:4e5f:9b1:77:aa02:1", "ip"),
    ("beacon 10 [.] 20 [.] 30 [.] 40 seen twice", "ip"), ("AAAA record points at 2a00:1450:4001:829::200e now", "ip"),
    ("paid with Visa 4556.7375.8689.9855 on Monday", "card"), ("my card  4716  4612  3456  7898 was declined", None), ("Kreditkarte: 5425/2334/3010/9903, gültig bis 04/27", "card"), ("Amex 3782/822463/10005 expired", "card"), ("card on file 4012 - 8888 - 8888 - 1881.", "card"),
    ("Ring me at (212) 555-0187 after six", "phone"), ("fax 030.1234.5678, attention Frau Wolf", "phone"), ("mobile: 415-555-2671 or by mail", "phone"), ("Tel 0044 207 9460 123 (weekdays)", "phone"), ("call the desk, 617 555 0143, before noon", "phone"), ("WhatsApp 0049.151.2345.678 is fastest", "phone"), ("phone (650) 555 0199 x12", "phone"),
    ("we met at noon. Then lunch at the lake. Fine", None), ("buy 3 @ 2.99 or 10 @ 9.50", None), ("at 12:30:45:09 the frame counter wrapped", None), ("ratio 1:2:3:4 in the mix", None), ("see section 2014.05.123 of the code", None),
    ("order no 555-123-4567 ships today", None), ("the score was 21-15 21-18 and 2019 2020 2021", None), ("ISBN 978 3161 4841 00", None), ("invoice 4111.2222.3333.44", None), ("he stayed at home dot matrix printers are loud", None),
    ("version 900[.]901[.]902[.]903 of nothing", None), ("part 3712/345678/90123 is out of stock", None), ("timestamp 2021-03-1234", None), ("id: 001234567890 was merged", None), ("page 123 456 789 of the ledger", None), ("mm:ss:ff:tt 10:20:30:40", None),
    ("look at this. Great stuff", None), ("total 1234-5678-9012-3", None), ("born 12.05.1984 in Linz", None), ("ref 2020-11-123 closed", None),
]


def test_pii_held_out_quality(spark):
    """Precision and recall of the added spans on texts that no training template made; the figures are in README."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(HELD)], "doc_id long, text string")
    right = wrong = lost = 0
    for r in pii.find_spans(df).collect():
        kind = HELD[r.doc_id][1]
        added = [s.kind for s in r.pii_spans if s not in r.pii_base]
        right += kind in added
        lost += kind is not None and kind not in added
        wrong += len(added) - (kind in added)
    assert right / (right + wrong) >= 0.9 and right / (right + lost) >= 0.85, (right, wrong, lost)


#: Written after the training was settled and judged once; nothing was chosen by these texts.
FRESH = [
    ("escalate to oncall[at]example-host.net before midnight", "email"), ("Drop a line: k.bauer (at) posteo (dot) de", "email"), ("the editor is lin @ quarterly.press", "email"), ("subscribe via join {at} lists {dot} debian {dot} org", "email"),
    ("ask helpdesk at campus dot edu for a badge", "email"), ("reply-to: noreply@ shop.example", "email"), ("my old address mira.k at tele2 (dot) se bounced", "email"), ("pgp key of otto [at] ccc.de", "email"),
    ("dropper contacted 45[.]33[.]32[.]156 twice", "ip"), ("peer 2001:470:1f0b:9a2::1 reset the session", "ip"), ("gateway is 172(.)16(.)4(.)9 inside", "ip"), ("ssh to fd12:3456:789a:1:2:3:4:5 failed", "ip"),
    ("charged to card 4485/2757/4230/8327 today", "card"), ("American Express 3714-496353-98431 on file", "card"), ("visa 4024.0071.0902.2143 refused", "card"),
    ("call (303) 555-0142 for a quote", "phone"), ("Telefon 0361 4455 8890", "phone"), ("mobile 00351 912 345 678", "phone"), ("fax: 312.555.0188", "phone"), ("text me on 617-555-0119, not by phone", "phone"),
    ("We stayed at Oxford. Com was down that day", None), ("She laughed at him. So did I", None), ("meet at noon. Bring bread. And wine", None), ("pay @ the till", None), ("6 eggs @ 0.25 each", None), ("shot at 1/250 dot matrix", None),
    ("laps 12:44:51:07 and 12:45:02:33", None), ("release 401.22.1983 notes", None), ("see 10 200 3000 40000", None), ("ISBN 0-306-40615-2 paperback", None), ("art. no 1234.5678.9012.3456", None), ("from 1998-12-100 to 1999-01-200", None),
    ("order 617-555-0119 packed", None), ("batch 0012345678901 passed", None), ("map tile 512/1024/2048", None), ("score 3:2:1:0 after extra time", None),
]


def test_pii_fresh_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FRESH)], "doc_id long, text string")
    added = {r.doc_id: [s.kind for s in r.pii_spans if s not in r.pii_base] for r in pii.find_spans(df).collect()}
    right = sum(k in added[i] for i, (_, k) in enumerate(FRESH) if k)
    wrong = sum(len(x) - (FRESH[i][1] in x) for i, x in added.items())
    # 16 of the 20, none wrong
    assert right >= 16 and wrong == 0, {FRESH[i][0]: x for i, x in added.items() if (FRESH[i][1] in x) != bool(FRESH[i][1])}


def test_pii_leaves_sentence_ends_alone(spark):
    """Prose with a bare " at " and a full stop is nobody's address."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvy") for _ in range(r.randint(2, 9)))
    rows = [(i, " ".join(f"{word()} at {word()}{r.choice(['.', '. ', '.  ', ' .'])}{r.choice([word(), word().capitalize(), 'Of', 'Com', 'de'])} {word()}" for _ in range(20))) for i in range(200)]
    found = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.where(F.size("pii_spans") > 0).count() == 0


def margin(fs, trees):
    def walk(node):
        while isinstance(node, list):
            node = node[2] if fs[node[0]] <= node[1] else node[3]
        return node

    total = 0.0
    for t in trees:
        total += walk(t["node"]) * t["w"]
    return total


def test_pii_spans_against_plain_version(spark):
    """All spans by a plain version: every generator's matches, scored one by one, overlaps settled greedily."""
    r = random.Random(21)
    bits = ["a@b.c", "jo (at) x (dot) org ", "jo [at] x.org ", "kim @ web . de", "5 @ 2.99 ", "10[.]2[.]3[.]4 ", "2001:db8:1:2:3:4:5:6 ", "12:30:45:09 ", "4556.7375.8689.9855 ", "3782/822463/10005 ", "card ", "call ", "fax: ", "(212) 555-0187 ", "0044 207 9460 123 ", "555 123 4567 ", "order no ", "2020-11-123 ", "word ", "é😀 ", ". "]
    texts = [t for t, _ in HELD] + ["".join(r.choice(bits) for _ in range(r.randint(1, 9))) for _ in range(250)] + ["x " * 20_000 + "call (212) 555 0187 now", "5 @ 2.99 " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("more", F.lit(1)).repartition(4)
    fitted = pii.model()
    rows = []
    for i, t in enumerate(texts):
        for k, kind in enumerate(pii.KINDS):
            if not any(x in t for x in pii.MORE_HAS[kind].split()) and pii.MORE_HAS[kind] or not re.search(pii.MORE_HINT[kind], t):
                continue
            seen = {(m.start(), m.end()) for g in pii.MORE[kind] for m in re.finditer(g, t)}
            rows += [(i, k, a, b, t[a:b], t[max(0, a - pii.BEFORE) : a], t[b : b + pii.AFTER]) for a, b in seen]
    one = spark.createDataFrame(rows, "i int, k int, a int, b int, hit string, before string, after string")
    made = []
    for k, kind in enumerate(pii.KINDS):
        made += one.where(F.col("k") == k).select("i", "k", "a", "b", F.array(*pii.features(kind, F.col("hit"), F.col("before"), F.col("after"))).alias("fs")).collect()
    want = {}
    for i, t in enumerate(texts):
        taken = [(s.split(":")[0], int(s.split(":")[1]), int(s.split(":")[2])) for s in base(t).split(",") if s]
        free = []
        for x in made:
            if x.i == i and (score := margin(x.fs, fitted["trees"]) - fitted["thresholds"][pii.KINDS[x.k]]) >= 0:
                free.append((-score, x.a, x.b, x.k))
        for _, a, b, k in sorted(free):
            if not any(s < b and a < e for _, s, e in taken):
                taken.append((pii.KINDS[k], a, b))
        want[i] = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(taken, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2])))
    got = {x.doc_id: x.s for x in pii.find_spans(df).select("doc_id", pii.as_text(F.col("pii_spans")).alias("s")).collect()}
    assert got == want and sum(len(w) > len(base(t)) for w, t in zip(want.values(), texts)) > 100
