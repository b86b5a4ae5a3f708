"""Personal data against brute force: base spans on odd texts, disclosing terms on a planted corpus,
the SQL on the same rows, and sanitised texts."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from pagesift.llm import pii

EXTRA = ["key", "term", "terms", "spans", "kind", "entity", "c", "contexts"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA)
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
TERM = re.compile(r"[^\W_]+")


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == 1:
        return all(int(p) <= 255 for p in value.split("."))
    if kind == 2:
        return 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def base(text):
    return sorted((m.start(), kind, m.end(), m.group()) for kind, p in enumerate(PATTERNS) for m in re.finditer(p, text) if good(kind, m.group()))


def brute(rows):
    texts = {t or "" for _, t in rows} - {""}
    around, owners = {}, {}
    for t in texts:
        for s, kind, e, v in base(t):
            entity = kind, re.sub("[^0-9]", "", v) if kind > 1 else v.lower()
            owners.setdefault(entity, set()).add(t)
            before, after = TERM.findall(t[max(s - 80, 0) : s]), TERM.findall(t[e : e + 80])
            before, after = before[1:] if s > 80 else before, after[:-1] if e + 80 < len(t) else after
            for w in before + after:
                around.setdefault((w.lower(), entity), set()).add(t)
    holds = Counter(w for t in texts for w in {w.lower() for w in TERM.findall(t)})
    level = {}
    for (w, entity), c in around.items():
        if len(c) >= 3 and len(owners[entity]) < len(texts):
            d = 1 - math.log(holds[w] / len(c)) / math.log(len(texts) / len(owners[entity]))
            level[w] = max(level.get(w, 0), d)
    out = []
    for i, t in rows:
        t = t or ""
        own = base(t)
        more = [(m.start(), 5 if level[w] >= pii.REMOVE else 4, m.end()) for m in TERM.finditer(t) if level.get(w := m.group().lower(), 0) >= pii.GENERALISE]
        more = [s for s in more if not any(b[0] < s[2] and s[0] < b[2] for b in own)]
        say = lambda spans: ",".join(f"{pii.KINDS[s[1]]}:{s[0]}:{s[2]}" for s in sorted(spans))
        out.append((i, *(sum(s[1] == k for s in own) for k in range(4)), hashlib.sha256(say(own).encode()).hexdigest(), say([s[:3] for s in own] + more)))
    return Counter(out)


def corpus():
    """Entities with a word that only they bring, one that others have too, and odd texts."""
    draw = random.Random(4)
    filler = [f"wort{i}" for i in range(200)] + ["the", "of", "Ünder", "7"]
    prose = lambda n: " ".join(draw.choices(filler, k=n))
    texts = [prose(draw.randint(5, 60)) for _ in range(250)]
    for i in range(6):
        texts.append(f"{prose(20)} Quixley wrote from Bo.Quix@mail.example.org about Vennhall {prose(20)}")
        texts.append(f"{prose(3)}\nZarnwitz, call +49 (30) 123-4567 today.\n{prose(4)}")
    texts += ["Only Quixley here, and a QUIXLEY.", f"{prose(9)} Vennhall {prose(9)}", "Zarnwitz alone"]
    texts += ["copies Manifold p@q.rr end"] * 7
    card = "4111 1111 1111 1111"
    texts += [card, card.replace(" ", "-"), "4111 1111 1111 1112", "1 2 3", "4111111111111111" * 3, f"{card}, 10.0.0.255 +1 415 555 26 71"]
    texts += ["1.2.3.4.5.6.7.8", "256.1.1.1 0001.002.3.04 1.1.1.99999999999999999999999", "a@b@c.d", "a@b.c_d@e.f@g.h", "x@y", "%@-.-", "é@ü.de é.x@a.de", "+1 (800) 555-0100, +12 3, +1-1, +1+2345678901"]
    texts += [None, "", " ", "🙂 🙂 m@n.op 🙂 1.1.1.1", "a" * 50_000, "1 " * 20_000, "a@b." + "c." * 20_000 + "d", "7" * 30_000, "x@y.z " * 3000, "9.9.9.9 Quixley " * 900]
    rows = list(enumerate(texts))
    return rows + [(None, "z@z.zz"), (None, None), rows[0], rows[0], (1, "an id again: 8.8.8.8")]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in corpus()], SCHEMA).repartition(4)


def test_spans_equal_brute_force_and_sql(frame):
    import duckdb

    want = brute(corpus())
    assert any("removed" in r[-1] for r in want) and any("generalised" in r[-1] for r in want) and any(r[0] is not None and not any(r[1:5]) and r[-1] for r in want)
    got = pii.find_pii(frame)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert Counter(map(tuple, got.collect())) == want
    documents = frame.select("doc_id", "text").toPandas()  # noqa: F841
    assert Counter(duckdb.sql(pii.ORACLE).fetchall()) == want


def test_sanitised_texts_hold_no_span(spark, frame):
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(frame).collect() if r["doc_id"] is not None}
    rows = corpus()
    at = {t: i for i, t in rows if t}
    assert pii.sanitise(frame).columns == frame.columns
    told = out[next(i for t, i in at.items() if "Bo.Quix" in t)]
    assert "[email]" in told and "@" not in told and "[name]" in told and "Vennhall" not in told
    assert out[at["Only Quixley here, and a QUIXLEY."]] == "Only Quixley here, and a QUIXLEY."  # others use it too
    assert out[at["Zarnwitz alone"]] == "[name] alone"
    assert out[at["copies Manifold p@q.rr end"]] == "copies Manifold [email] end"  # one text, however often
    assert out[at["4111 1111 1111 1111, 10.0.0.255 +1 415 555 26 71"]] == "[card], [ip] [phone]"
    assert all(out[i] == t for i, t in rows if i and t is None)
    assert out[2] == rows[2][1]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.find_pii(empty).collect() == [] and pii.sanitise(empty).collect() == []


def test_running_totals(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 63, 64, 65, 200, 5000):
        values = [(i * 7919) % 13 for i in range(n)]
        df = spark.createDataFrame([(values,)], "a array<long>")
        sums, most = df.select(pii._running(F.col("a"), lambda x, y: x + y, F.lit(0).cast("long")), pii._running(F.col("a"), lambda x, y: F.greatest(x, y), F.lit(0).cast("long"))).first()
        assert sums == [sum(values[: i + 1]) for i in range(n)] and most == [max(values[: i + 1]) for i in range(n)]
