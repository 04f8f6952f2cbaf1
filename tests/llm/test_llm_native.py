"""Mixing, line dedup and secret scans."""

import pytest
from llm import brute, messy
from pyspark.sql import functions as F

from foldlight.llm import lines, mixing, queries, secrets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_its_sql(spark, duck, rows, name):
    found, wanted = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns) and rows(found) == rows(wanted)


def test_native_plans_have_no_python(spark):
    for name in ("op3_mix_sources", "op9_line_dedup", "op10_secret_scans"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mix(spark):
    rows = messy.texts()
    docs = messy.documents(spark, rows)
    sources = [r["source"] for r in docs.orderBy("row").collect()]
    wanted = brute.mix([(d, t, s) for (d, t), s in zip(rows, sources, strict=True)])
    found = [tuple(r)[:6] for r in mixing.mix(docs).collect()]
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    for a, b in zip(sorted(found, key=key), sorted(wanted, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == b[5]
    assert all(r[5] <= 2 * r[2] for r in found)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == messy.COLUMNS
    count = {}
    for r in mixed.collect():
        count[r["row"]] = count.get(r["row"], 0) + 1
    times = {(r["doc_id"], r["size"], r["source"]): r["times"] for r in mixing.mix(docs).collect()}
    for k, ((d, t), s) in enumerate(zip(rows, sources, strict=True)):
        assert count.get(k, 0) == times[d, len(brute.words(t)), s]


def test_mix_refines_one_bucket_after_the_other(spark):
    rows = [(k, "w " * (1 + k % 7)) for k in range(3000)]
    docs = messy.documents(spark, rows)
    found = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"), F.first("source_size").alias("s")).collect()
    assert all(abs(r["n"] - r["t"]) <= 7 and r["t"] <= 2 * r["s"] for r in found)
    assert sum(r["t"] for r in found) == pytest.approx(1.5 * sum(r["s"] for r in found))


def test_mix_of_rows_without_ids(spark):
    docs = messy.documents(spark, [(None, f"{k} " + "w " * (k % 7)) for k in range(3000)])
    found = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(r["n"] - r["t"]) <= 7 for r in found)


def test_lines(spark):
    rows = messy.texts()
    found = sorted(((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept"]) for r in lines.dedup_lines(messy.documents(spark, rows)).collect()))
    assert found == sorted((str(d), *w) for (d, _), w in zip(rows, brute.dedup_lines(rows), strict=True))


def test_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_LEAST", 3)
    rows = [(k, f"the line of everyone\nown line number {k % 50}\nlast line of all") for k in range(200)]
    found = {r["doc_id"]: (r["n_dropped"], r["kept"]) for r in lines.dedup_lines(messy.documents(spark, rows)).collect()}
    wanted = {d: w[1:] for (d, _), w in zip(rows, brute.dedup_lines(rows), strict=True)}
    assert found == wanted


def test_secrets(spark):
    rows = messy.texts() + [(20, "a9fK2mQ7vLx0ZpR4tWb8Yc3 plain"), (21, "id 3f2504e0-4f89-11d3-9a0c-0305e82c3301 and aaaaaaaaaaaaaaaaaaaaaaaa1"), (22, "PASSWORD:abcdefgh'; passwd=\"12345678\" secret  :  xxxxxxxxx"), (23, "AKIA AKIAAKIAAKIAAKIA" + "0" * 40)]
    found = secrets.scan_secrets(messy.documents(spark, rows))
    for r, (_, t) in zip(sorted(secrets.secret_digests(found).collect(), key=lambda r: (str(r["doc_id"]), r["base_sha256"])), sorted(rows, key=lambda x: (str(x[0]), brute.sha(brute.secrets(x[1])))), strict=True):
        assert r["base_sha256"] == brute.sha(brute.secrets(t))
        assert brute.secrets(t) == ",".join(s for s in r["spans"].split(",") if s and not s.startswith("entropy"))
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_digests(found).collect()}
    assert spans[20] == "entropy:0:23" and "entropy" not in spans[21] and "entropy" not in spans[14]


def allowed(value):
    import re

    if re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+", value) or not re.sub(secrets.PLACEHOLDER, "", value):
        return True
    pieces = [p for p in re.split("[-_/+=]+", re.sub("([a-z])([A-Z])", r"\1-\2", value)) if p]
    like = lambda p: len(p) <= 24 and (p.isupper() or p[1:].islower() or len(p) == 1) and (len(p) <= 3 or set(p.lower()) & set("aeiouy")) and not re.search("[bcdfghjklmnpqrstvwxz]{6}", p.lower())
    return not re.search("[0-9]", value) and all(map(like, pieces)) and sum(map(len, pieces)) >= 3 * len(pieces)


def test_allow_list(spark):
    words = ["getUserNameFromTokenStore", "some_long_snake_case_name", "src/main/java/com/example", "your-api-key-here-xxxxxxxx", "internationalisation", "2024-01-02/2024-02-03", "3f2504e0-4f89-11d3-9a0c-0305e82c3301"]
    keys = ["aGhTkLpQwErTyUiOpZxC", "qwrtpsdfghjklzxcvbnmq", "examplewJalrXUtnFEMIbPxRfiCY", "zQxVkJwPyB-mTnDrFgHcLs"]
    found = {r["doc_id"]: r["spans"] for r in secrets.secret_digests(secrets.scan_secrets(messy.documents(spark, list(enumerate(words + keys))))).collect()}
    assert [bool(found[k]) for k in range(len(words + keys))] == [False] * len(words) + [True] * len(keys)
    assert [allowed(x) for x in words + keys] == [True] * len(words) + [False] * len(keys)


def test_long_candidates(spark):
    """Neither a stack that overflows nor a window lost where a candidate is walked in pieces."""
    import random

    pick = random.Random(5)
    key = "".join(pick.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    flat = "aZ1" * (secrets.PIECE // 3 - 3)
    rows = [(1, "a-" * 300_000), (2, "example-" * 100_000), (3, flat + key + flat), (4, "x" * 500_000), (5, flat), (6, "aB" * 100_000)]
    found = {r["doc_id"]: r["spans"] for r in secrets.secret_digests(secrets.scan_secrets(messy.documents(spark, rows))).collect()}
    wanted = entropy_spans(rows[2][1][len(flat) - 60 : len(flat) + 90])
    shift = lambda s: ":".join([s.split(":")[0], *(str(int(x) + len(flat) - 60) for x in s.split(":")[1:])])
    assert found[3] == shift(wanted[0]) and len(flat) < secrets.PIECE < len(flat) + 24
    assert [found[k] for k in (1, 2, 4, 5, 6)] == [""] * 5


def entropy_spans(text):
    """All windows counted afresh."""
    import math
    import re
    from collections import Counter

    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text):
        if allowed(m[0]):
            continue
        limit = secrets.HEX_BITS if re.fullmatch("[0-9a-f]+|[0-9A-F]+", m[0]) else secrets.ALNUM_BITS if re.fullmatch("[A-Za-z0-9]+", m[0]) else secrets.BASE64_BITS
        good = [i for i in range(len(m[0]) - 19) if -sum(n / 20 * math.log2(n / 20) for n in Counter(m[0][i : i + 20]).values()) >= limit - 1e-9]
        if good:
            out.append(f"entropy:{m.start() + good[0]}:{m.start() + good[-1] + 20}")
    return out


def test_entropy_windows(spark):
    import random

    pick = random.Random(3)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCabc012+/=_-", "aB1"]
    rows = [(k, " ".join("".join(pick.choice(a) for _ in range(pick.randint(10, 60))) for a in pick.sample(alphabets, 3))) for k in range(60)]
    found = {r["doc_id"]: r["spans"] for r in secrets.secret_digests(secrets.scan_secrets(messy.documents(spark, rows))).collect()}
    for k, text in rows:
        base = [tuple(map(int, s.split(":")[1:])) for s in brute.secrets(text).split(",") if s]
        wanted = [s for s in entropy_spans(text) if not any(a <= int(s.split(":")[1]) and int(s.split(":")[2]) <= b for a, b in base)]
        assert [s for s in found[k].split(",") if s.startswith("entropy")] == wanted


def test_empty_tables(spark):
    docs = messy.empty(spark)
    assert mixing.mix(docs).count() == 0 and mixing.mixed_rows(docs).count() == 0 and lines.dedup_lines(docs).count() == 0 and secrets.scan_secrets(docs).count() == 0


def test_many_secrets_in_a_text(spark):
    """Spans of tens of thousands of matches, and entropy spans inside and outside of base spans."""
    import random

    pick = random.Random(4)
    key = lambda n: "".join(pick.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(n))
    dense = "token=abcdefgh1 " * 20_000
    mixed = [(f"secret={key(40)}", key(40), f"api_key: {key(30)}", "0123456789abcdef" * 3, f"AKIA{key(20).upper()}")[k % 5] for k in range(3000)]
    found = {r["doc_id"]: r["spans"].split(",") for r in secrets.secret_digests(secrets.scan_secrets(spark.createDataFrame([(1, dense), (2, "é ".join(mixed))], "doc_id long, text string"))).collect()}
    for doc, text in ((1, dense), (2, "é ".join(mixed))):
        assert ",".join(s for s in found[doc] if not s.startswith("entropy")) == brute.secrets(text)
    spans = [(s.split(":")[0], int(s.split(":")[1]), int(s.split(":")[2])) for s in found[2]]
    base = [(a, b) for k, a, b in spans if k != "entropy"]
    free = [(a, b) for k, a, b in spans if k == "entropy"]
    assert [a for _, a, _ in spans] == sorted(a for _, a, _ in spans) and len(free) > 500
    ends = dict(base)
    assert not any(a in ends and ends[a] >= b for a, b in free) and all(not (c <= a and b <= d) for a, b in free[:50] for c, d in base)


def test_lines_of_long_documents(spark):
    """Bits of the dropped lines by position, with stretches of lines that stay between them."""
    one = [f"line number {k} of the first text" for k in range(30_000)]
    two = [x if k % 777 < 2 else f"another line {k} of its own" for k, x in enumerate(one)]
    rows = [(1, "\n".join(one)), (2, "\n".join(two)), (3, "\n".join(one))]
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = dict(zip((1, 2, 3), brute.dedup_lines(rows), strict=True))
    assert found == wanted and found[3][1] == 30_000
