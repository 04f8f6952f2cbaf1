"""Fill-in-the-middle, filter audit and fingerprints."""

import hashlib
import math
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import regex
from llm import brute, messy
from pyspark.sql import functions as F

from foldlight.llm import filter_audit, fim, fingerprints, queries
from foldlight.llm import textkernel as tk

MARKED = [(20, "a <P> b\nc"), (21, "<\n<S\n<M\n>x\n<P"), (22, "one line"), (23, "\n\n\n"), (24, "<S><S"), (25, "a\r\nb\x0bc\n" * 500)]


def cut(doc_id, text):
    """The stated procedure, line by line."""
    text = text or ""
    units = regex.findall(r"[^\n]*\n|[^\n]+", text)
    seed = hashlib.sha256((f"7:text:{text}" if doc_id is None else f"7:{doc_id}").encode()).hexdigest()
    h1, h2, _, h4 = (int(seed[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text:
        return doc_id, len(units), "plain", None, None, text
    low, high = min(h1 % (len(units) + 1), h2 % (len(units) + 1)), max(h1 % (len(units) + 1), h2 % (len(units) + 1))
    p, m, s = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    rows = [*messy.texts(), *MARKED]
    found = fim.restore_texts(fim.fill_in_middle(messy.documents(spark, rows))).collect()
    key = lambda r: (str(r[0]), r[5])
    assert sorted((tuple(r)[:6] for r in found), key=key) == sorted((cut(d, t) for d, t in rows), key=key)
    assert all(r["output_sha256"] == brute.sha(r["output"]) and r["restored_sha256"] == brute.sha(r["restored"]) for r in found)
    assert Counter(r["restored"] for r in found) == Counter(t or "" for _, t in rows)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_fill_in_middle_rates(spark):
    docs = messy.documents(spark, [(k, f"{k}\nb\nc\nd") for k in range(400)])
    count = Counter(r["form"] for r in fim.fill_in_middle(docs, rate=50, spm=20).collect())
    assert 150 < count["plain"] < 250 and 20 < count["spm"] < 65
    assert fim.fill_in_middle(messy.empty(spark)).count() == 0
    assert [tuple(r) for r in fim.fill_in_middle(docs, seed=8).collect()] != [tuple(r) for r in fim.fill_in_middle(docs).collect()]


def test_long_text_of_short_lines():
    text = "ab\n" * 400_000
    for key in ("7:1", "7:2", "7:3", "7:4"):
        n, form, _, _, output = fim.transform(key, text)
        assert n == 400_000 and fim.restore(output, form) == text


def audit(rows, labels):
    """rows: (doc_id, text, part); counts by (part, order, step), each order walked document by document."""
    last = 1 << 62
    ids = {}
    for d, t, _ in rows:
        ids.setdefault(t or "", []).append(last if d is None else d)
    docs = []
    for d, t, part in rows:
        text, w = t or "", brute.words(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text), "E": min(ids[text]) < (last if d is None else d)}
        flags = [x for k, *x in labels if k == d and d is not None]
        docs.append((part or "", {f for f in fails if fails[f]}, any(q == 1 for q, _ in flags), any(x == 1 for _, x in flags)))
    out, removed_by = {}, Counter()
    for part in {p for p, *_ in docs}:
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                c = Counter()
                for p, fails, good, toxic in docs:
                    if p == part:
                        before = fails & set(order[: step - 1])
                        c["kept"] += not before and f not in fails
                        c["unique_fails"] += fails == {f}
                        if f in fails:
                            c["redundant" if before else "removed"] += 1
                            c["good_lost"] += good and not before
                            c["toxic_lost"] += toxic and not before
                out[part, order, step] = c
                removed_by[part, f] += c["removed"]
    return {(p, o, s): (*(c[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), removed_by[p, o[s - 1]]) for (p, o, s), c in out.items()}


def test_filter_audit(spark):
    plain = "Many words stand here, each one a little different from another: " + " ".join(messy.passage(50, 60).split())
    texts = [(t if d != 14 else t[:4000]) for d, t in messy.texts()]
    rows = [(d, t) for (d, _), t in zip(messy.texts(), texts, strict=True)]
    rows += [(40 + k, plain) for k in range(4)] + [(None, plain), (None, plain), (40, plain), (60, plain + " #"), (61, plain.upper()), (62, " ".join(["same"] * 80)), (63, " ".join(["SAME"] * 80) + "*")]
    docs = messy.documents(spark, rows)
    parts = [r["source"] for r in docs.orderBy("row").collect()]
    labels = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (5, 1, 1), (41, 1, 0), (41, 0, 1), (42, None, 1), (60, 1, None), (62, 1, 1), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame([(*x, "extra") for x in labels], "doc_id long, quality int, toxic int, part string")
    found = {(r[0], r[1], r[2]): tuple(r)[3:] for r in filter_audit.interaction_audit(docs, table).collect()}
    assert found == audit([(d, t, p) for (d, t), p in zip(rows, parts, strict=True)], labels)
    assert filter_audit.interaction_audit(messy.empty(spark), table).count() == 0
    alone = filter_audit.interaction_audit(messy.documents(spark, [(1, "x")]), table.limit(0)).collect()
    assert len(alone) == 600 and {r["shapley"] for r in alone if r["filter_order"][r["step"] - 1] == "A"} == {120}


def test_lattice_has_80_edges(spark):
    counts = spark.createDataFrame([("p", 0, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    edges = filter_audit.lattice_edges(counts)
    assert edges.count() == 80 and edges.select("applied", "filter").distinct().count() == 80 and len(filter_audit.order_steps()) == 600
    assert sum(math.factorial(k) * math.factorial(4 - k) * math.comb(4, k) for k in range(5)) == 120


def test_audit_of_copies_in_one_group(spark):
    """Most rows are one text: identity is counted, no row is lost."""
    rows = [(k, "the same text " * 20) for k in range(3000)] + [(5000 + k, messy.passage(k, 60)) for k in range(30)]
    found = filter_audit.interaction_audit(messy.documents(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    first = found.where("filter_order = 'EABCD' and step = 1").agg(F.sum("removed"), F.sum("kept")).first()
    assert tuple(first) == (2999, 31)


def sample(word_counts, j):
    """One consistent weighted sample, word by word."""
    all64, odd, step = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xA24BAED4963EE407

    def mix(x):
        for _ in range(2):
            x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & all64
        return x ^ (x >> 32)

    u = lambda b: (b + 0.5) / 2**32
    gamma = lambda x: -math.log(u(x & 0xFFFFFFFF) * u(x >> 32))
    best = None
    for h, n in word_counts.items():
        x = mix((h + odd * (j + 1)) & all64)
        y = mix(x ^ step)
        r, c, b = gamma(x), gamma(y), u(mix((y + step) & all64) >> 32)
        t = math.floor(math.log(n) / r + b)
        y_k = math.exp(r * (t - b))
        a = c / (y_k * math.exp(r))
        if best is None or a < best[0]:
            best = a, mix((h + mix((t + odd) & all64)) & all64) >> 48
    return best[1] if best else 0


def bag(text):
    words = brute.words((text or "").translate(brute.LOWER))
    if not words:
        return Counter()
    data = pa.array(words, pa.large_string())
    bytes_, offsets = tk.text_bytes(data)
    return Counter(int(h) for h in tk.span_hashes(bytes_, offsets[:-1], offsets[1:]))


def printed(text, samples=fingerprints.SAMPLES):
    b = bag(text)
    return "".join(f"{sample(b, j):04x}" for j in range(samples))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def equal_share(a, b):
    return sum(a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)) / (len(a) // 4)


@pytest.mark.parametrize("partitions", [1, 7])
def test_next_likeness(spark, partitions):
    rows, seen = [], set()
    for d, t in messy.texts():  # ids once: rows of one id are ordered by a hash
        if d not in seen:
            seen.add(d)
            rows.append((d, t if d != 14 else t[:3000] + t[-500:]))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = {r["doc_id"]: tuple(r)[1:] for r in fingerprints.next_likeness(messy.documents(spark, rows).repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    line = ordered(rows)
    assert len(found) == len(rows)
    for (d, t), (_, after) in zip(line, line[1:] + line[:1], strict=True):
        t, after = t or "", after or ""
        n = len(t) // 3
        changed = t[: len(t) - n] + after[:n]
        one, two, three = printed(t), printed(changed), printed(after)
        assert found[d] == (len(t), brute.sha(changed), one, two, equal_share(one, two), equal_share(one, three))


def test_every_row_has_a_next_one(spark):
    """Repeated ids, no ids, repeated rows: a row each; equal texts have equal fingerprints whatever stands beside them."""
    rows = messy.texts() * 3 + [(None, "same words")] * 50
    found = fingerprints.next_likeness(messy.documents(spark, rows).repartition(6)).collect()
    assert sorted(map(str, (r["doc_id"] for r in found))) == sorted(str(d) for d, _ in rows)
    prints = {r["fingerprint"] for r in fingerprints.document_fingerprints(messy.documents(spark, rows)).collect()}
    assert {r["fingerprint"] for r in found} == prints
    alone = fingerprints.next_likeness(messy.documents(spark, [(1, "a b c d e f")])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert fingerprints.next_likeness(messy.empty(spark)).count() == 0


def test_collision_rate_is_generalised_jaccard():
    """1,000 samples of pairs of weighted texts lie within four standard deviations of sum(min) / sum(max)."""
    pick = np.random.default_rng(3)
    words = [messy.passage(k, 1) for k in range(40)]
    for k in range(12):
        one, two = pick.integers(0, 1 + 2 * k, 40), pick.integers(0, 9, 40)
        two = np.where(pick.random(40) < 0.5, one, two)
        texts = [" ".join(w for w, n in zip(words, c, strict=True) for _ in range(n)) for c in (one, two)]
        a, b = (bag(t) for t in texts)
        wanted = sum(min(a[x], b[x]) for x in a | b) / max(sum(max(a[x], b[x]) for x in a | b), 1)
        found = fingerprints.signatures(*tk.text_bytes(pa.array(texts, pa.large_string())), 1000)
        assert abs((found[0] == found[1]).mean() - wanted) <= 4 * math.sqrt(wanted * (1 - wanted) / 1000) + 1e-9


def test_likeness_column(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g x"), (3, "")], "doc_id long, text string")
    prints = fingerprints.document_fingerprints(docs)
    got = {(r[0], r[1]): r[2] for r in prints.alias("a").join(prints.alias("b"), F.expr("a.doc_id <= b.doc_id")).select("a.doc_id", "b.doc_id", fingerprints.likeness(F.col("a.fingerprint"), F.col("b.fingerprint"))).collect()}
    assert got[1, 1] == got[3, 3] == 1.0 and 0.5 < got[1, 2] < 1 and got[1, 3] < 0.1


def test_queries_return_the_contract_columns(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.op11_fill_in_middle(spark, sf).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert queries.op12_filter_audit(spark, sf).columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert queries.op13_document_fingerprints(spark, sf).columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
