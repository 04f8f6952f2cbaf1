"""Quality, SimHash, substring dedup, decontamination: against brute force on documents with everything that goes wrong."""

import random

import numpy as np
import pyarrow as pa
import pytest
from llm import brute, messy
from pyspark.sql import functions as F

from foldlight.llm import decontaminate, quality, queries, simhash, substrings
from foldlight.llm import textkernel as tk

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_chunks_keep_whole_rows():
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(5)), "text": pa.array(["abc", None, "", "d" * 50, "é"])})
    for size in (1, 4, 40, 1000):
        parts = list(tk.chunks(batch, "text", size))
        assert sum((p.column(1).to_pylist() for p in parts), []) == batch.column(1).to_pylist()
    data, offsets = tk.text_bytes(batch.column(1).slice(2, 3))
    assert offsets.tolist() == [0, 0, 50, 52] and len(data) == 52


def test_quality(spark, corpus):
    for rows, docs in ((messy.texts(), messy.documents(spark)), (corpus, spark.read.parquet(f"{SF}/documents.parquet"))):
        found = sorted((tuple(r) for r in quality.quality_verdicts(docs).collect()), key=str)
        names = quality.quality_verdicts(docs).columns
        wanted = sorted(((d, *brute.quality(t)) for d, t in rows), key=str)
        assert sorted((f[:6] for f in found), key=str) == wanted
        text = {}
        for d, t in rows:
            text.setdefault((d, *brute.quality(t)), t)
        for f in found:
            r = dict(zip(names, f, strict=True))
            for n in quality.COVERAGE_LIMITS:
                assert r[f"dup_{n}gram_share"] == pytest.approx(brute.coverage(text[f[:6]], n))
            failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
            assert r["base_failed"] == failed and r["kept"] == (not failed and all(r[f"dup_{n}gram_share"] <= m for n, m in quality.COVERAGE_LIMITS.items()) and r["dup_line_share"] <= quality.LINE_LIMIT)
    assert quality.quality_verdicts(messy.empty(spark)).count() == 0


def test_line_shares(spark):
    docs = messy.documents(spark, [(1, "ab cd\nab cd\nxx"), (2, "ab cd\n ab cd"), (3, "\n\n\n"), (4, "ab\nab")])
    found = {r["doc_id"]: (r["n_dup_lines"], round(r["dup_line_share"], 6)) for r in quality.repetition_measures(docs).collect()}
    assert found == {1: (1, 0.4), 2: (0, 0.0), 3: (0, 0.0), 4: (1, 0.5)}


def test_fingerprints(spark, corpus):
    for rows, docs in ((messy.texts(), messy.documents(spark)), (corpus, spark.read.parquet(f"{SF}/documents.parquet"))):
        found = sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in simhash.document_fingerprints(docs).collect()), key=str)
        assert found == sorted(((d, brute.fingerprint(t)) for d, t in rows), key=str)


def test_masks_cover_every_pair_within_the_radius():
    pick = random.Random(1)
    for radius in (1, 2, 3, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            differ = sum(1 << b for b in pick.sample(range(64), radius))
            assert any(not differ & m for m in masks)


def test_components_of_random_balls(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_BITS", 3)  # many blocks a bucket
    pick = random.Random(2)
    centres = [pick.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in pick.sample(range(64), pick.randrange(6))) for c in centres for _ in range(60)} | {pick.getrandbits(64) for _ in range(100)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    edges = simhash.near_links(spark.createDataFrame(signed, "fp long").select(F.col("fp").alias("node"), "fp"))
    assert edges.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > 3).count() == 0
    found = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in simhash.components(edges).collect()}
    values = [(k, f) for k, f in enumerate(sorted(prints))]
    wanted = dict(zip([f for _, f in values], brute.component_ids(values), strict=True))
    groups = {}
    for f in prints:
        groups.setdefault(found.get(f, f), set()).add(f)
    theirs = {}
    for f in prints:
        theirs.setdefault(wanted[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "u long, v long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert {found[k] for k in range(61)} == {0} and found[101] == 100


def counted_tables(monkeypatch):
    """Names of the tables that simhash stages from now on."""
    names, stage = [], simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, what: names.append(what) or stage(df, what))
    return names


def test_components_of_a_long_chain_take_one_round(spark, monkeypatch):
    """Each round is a plan that the driver keeps: what one task holds is drawn together before the first."""
    names = counted_tables(monkeypatch)
    edges = spark.range(0, 5000, 1, 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert simhash.components(edges).agg(F.count("*"), F.max("root")).first()[:] == (5001, 0)
    assert len(names) == 3
    assert simhash.components(edges.where("u < 0")).count() == 0


def least_reached(edges):
    parent = {}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        parent.setdefault(a, a), parent.setdefault(b, b)
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in parent}


def test_components_dealt_to_many_tasks_take_few_rows(spark, monkeypatch):
    """Rounds go on with what is open only: not with all edges and nodes once more for each of them."""
    names, rows, stage = [], [], simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, what: (out := stage(df, what), names.append(what), rows.append(out.count()))[0])
    pick = random.Random(31)
    order = pick.sample(range(1500), 1500)
    edges = [*zip(order[:-1], order[1:], strict=True), *((1500 + pick.randrange(300), 1500 + pick.randrange(300)) for _ in range(900))]
    pick.shuffle(edges)
    dealt = spark.createDataFrame(edges, "u long, v long").repartition(12)
    wanted = least_reached([(a, b) for a, b in edges if a != b])
    assert {r["node"]: r["root"] for r in simhash.components(dealt).collect()} == wanted
    assert len(names) <= 5 and sum(rows) <= 4 * len(edges)
    monkeypatch.setattr(simhash, "RUN_EDGES", 20)  # many rounds before the rest fits one task
    rows.clear(), names.clear()
    assert {r["node"]: r["root"] for r in simhash.components(dealt).collect()} == wanted
    assert len(names) > 5


def test_stars_keep_the_closure(monkeypatch):
    monkeypatch.setattr(simhash, "RUN_EDGES", 50)
    pick = np.random.default_rng(9)
    u, v = pick.integers(-300, 300, (2, 400))
    batches = [pa.RecordBatch.from_arrays([pa.array(u[k : k + 20]), pa.array(v[k : k + 20])], names=["u", "v"]) for k in range(0, 400, 20)]
    found = [tuple(r.values()) for b in simhash._stars(batches) for r in b.to_pylist()]
    assert {(b, a) for a, b in found} == set(found) and all(a != b for a, b in found)

    def roots(edges):
        parent = {k: k for k in range(-300, 300)}

        def root(k):
            while parent[k] != k:
                k = parent[k]
            return k

        for a, b in edges:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return {k: root(k) for k in parent}

    assert roots(found) == roots(zip(u.tolist(), v.tolist(), strict=True))


def test_near_copies_without_failing_links_are_joined_once(spark, monkeypatch):
    names = counted_tables(monkeypatch)
    rows = [(10 * k + j, " ".join([*messy.passage(70_000 + k, 100).split(), *["more"] * j])) for k in range(8) for j in range(3)]
    found = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {d: d - d % 10 for d, _ in rows}
    assert "links-between" not in names and "components" not in names and names.count("near-links") == 1 + simhash.NEAR_BLOCKS


def test_simhash_documents(spark, corpus):
    for rows, docs in ((messy.texts(), messy.documents(spark)), (corpus, spark.read.parquet(f"{SF}/documents.parquet"))):
        found = sorted(((r["doc_id"], r["component_id"]) for r in simhash.simhash_components(docs).collect()), key=str)
        prints = [(d, brute.fingerprint(t)) for d, t in rows]
        assert found == sorted(zip([d for d, _ in rows], brute.component_ids(prints), strict=True), key=str)
        kept = simhash.one_per_group(docs)
        assert kept.columns == docs.columns
        dropped = {d for (d, _), c in zip(prints, brute.component_ids(prints), strict=True) if d is not None and d != c}
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((d for d, _ in rows if d not in dropped), key=str)
    assert simhash.simhash_components(messy.empty(spark)).count() == 0 and simhash.one_per_group(messy.empty(spark)).count() == 0


def shingle_sets(rows):
    out = {}
    for d, t in rows:
        w = brute.words((t or "").translate(brute.LOWER))
        out[d] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
    return out


def test_near_copies(spark, corpus):
    """Linked are exact copies and verified pairs only; nearly all pairs at 0.8 are."""
    pick = random.Random(12)
    rows = [(k, t) for k, t in corpus]
    for k in range(60):  # edited copies, from slightly to beyond 0.8
        w = messy.passage(50_000 + k, 120).split()
        for j in range(3):
            copy = list(w)
            for at in pick.sample(range(120), pick.randrange(0, 5) if j else 0):
                copy[at] = f"x{pick.randrange(10**6)}"
            rows.append((100_000 + 10 * k + j, " ".join(copy)))
    rows += [(200_000, "UPPER case  Text"), (200_001, "upper CASE\ntext"), (200_002, None), (200_003, "")]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(messy.documents(spark, [*rows, (None, rows[0][1])])).collect()}
    sets = shingle_sets(rows)
    near, parent = [], {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    for a, b in {(a, b) for ds in holders.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            near.append((a, b))
            parent[max(root(a), root(b))] = min(root(a), root(b))
    together = sum(found[a] == found[b] for a, b in near)
    assert len(near) > 100 and together >= 0.95 * len(near)
    assert all(root(d) == root(c) for d, c in found.items()), "no link without a chain of similar pairs"
    assert all(found[a] == found[b] for a, b in near if sets[a] == sets[b] and brute.words(dict(rows)[a]) == brute.words(dict(rows)[b]))
    assert found[200_001] == 200_000 and found[200_003] == found[200_002] and None not in found
    kept = simhash.one_of_near_copies(messy.documents(spark))
    assert kept.columns == messy.COLUMNS and {r["doc_id"] for r in kept.collect()} == {d for d, _ in messy.texts()} - {2, 6, 7, 9}
    assert simhash.near_copies(messy.empty(spark)).count() == 0 and simhash.one_of_near_copies(messy.empty(spark)).count() == 0


def test_large_buckets_are_divided(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_BITS", 2)
    pick = random.Random(3)
    centre = pick.getrandbits(62)
    prints = {centre ^ sum(1 << b for b in pick.sample(range(20), pick.randrange(5))) for _ in range(300)}
    edges = simhash.near_links(spark.createDataFrame([(f, f) for f in prints], "node long, fp long"), 2).collect()
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for r in edges:
        assert (r["u"] ^ r["v"]).bit_count() <= 2
        parent[root(r["u"])] = root(r["v"])
    assert all(root(a) == root(b) for a in prints for b in prints if (a ^ b).bit_count() <= 2)


@pytest.mark.parametrize(("window", "least"), [(20, 10), (20, 5), (20, 20), (7, 3), (12, 3), (1, 1)])
def test_substrings(spark, window, least):
    pick = random.Random(window)
    small = [" ".join(pick.choice("ab c d e f g".split()) for _ in range(pick.randrange(120))) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(small)] + [(100, None), (101, ""), (102, small[3]), (103, f"{small[5]}\n{small[6]}"), (104, messy.passage(3, 3000)), (105, messy.passage(3, 3000))]
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.dedup_substrings(messy.documents(spark, rows), window=window, least=least).collect()}
    wanted = brute.dedup_substrings(rows, window)
    assert found == {d: w for (d, _), w in zip(rows, wanted, strict=True)}


def test_substrings_of_messy_documents(spark):
    rows = messy.texts()
    found = substrings.dedup_substrings(messy.documents(spark, rows)).collect()
    assert len(found) == len(rows)
    # Ids that stand once, and none: the others' order is the operator's own.
    ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    wanted = dict(zip([d for d, _ in ordered], brute.dedup_substrings(ordered, 20), strict=True))
    for r in found:
        if r["doc_id"] not in (None, 13):
            assert (r["n_words"], r["n_removed"], r["kept"]) == wanted[r["doc_id"]]
    assert {r["n_removed"] for r in found if r["doc_id"] == 13} == {0}  # one text given twice is one text
    assert substrings.dedup_substrings(messy.empty(spark)).count() == 0


def test_substrings_without_ids(spark):
    shared = messy.passage(40, 25)
    rows = [(1, f"{messy.passage(41)} {shared}"), (None, f"{shared} {messy.passage(42)}"), (None, f"{messy.passage(43)} {shared}"), (None, messy.passage(44)), (None, messy.passage(44))]
    found = sorted((r["n_words"], r["n_removed"]) for r in substrings.dedup_substrings(messy.documents(spark, rows)).collect())
    assert found == [(60, 0), (60, 0), (85, 0), (85, 25), (85, 25)]


def test_substrings_of_many_texts_of_one_id(spark):
    """Different texts of one id are documents of their own, however many; ids may be any number."""
    pick = random.Random(9)
    shared = messy.passage(45, 30)
    texts = [messy.passage(10_000 + k, 25) for k in range(1500)] + [f"{messy.passage(20_000 + k, 5)} a{k}z {shared} b{k}z {messy.passage(30_000 + k, 3)}" for k in range(1500)]
    pick.shuffle(texts)
    rows = [((1 << 62) + 5, t) for t in texts] + [((1 << 62) + 4, f"{shared} first"), (None, shared), ((1 << 63) - 2, shared)]
    found = {}
    for r in substrings.dedup_substrings(messy.documents(spark, rows)).collect():
        found.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    assert sorted(found[(1 << 62) + 5]) == sorted([(25, 0)] * 1500 + [(40, 30)] * 1500)
    assert found[(1 << 62) + 4] == [(31, 0)] and found[None] == found[(1 << 63) - 2] == [(30, 30)]


def test_substring_query(spark, corpus):
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op5_substring_dedup(spark, SF).collect()}
    assert found == {d: (n, m, brute.sha(kept)) for (d, _), (n, m, kept) in zip(corpus, brute.dedup_substrings(corpus, 20), strict=True)}


def edits(a, b):
    """Least edits from a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    pick = random.Random(4)
    items = [(k, messy.passage(200 + k, pick.randint(12, 50))) for k in range(12)] + [(20, None), (21, "short one"), (22, ""), (None, messy.passage(300, 30)), (23, messy.passage(301, 200))]

    def damaged(text, n):
        text = list(text)
        for _ in range(n):
            at = pick.randrange(len(text))
            change = pick.randrange(3)
            text[at : at + (change > 0)] = pick.choice("xyzé") * (change < 2)
        return "".join(text)

    rows = []
    for k, (_, text) in enumerate(items[:12]):
        budget = len(text) // 10
        rows.append((k, f"{messy.passage(400 + k)} {damaged(text, pick.randint(0, budget))} {messy.passage(500 + k)}"))
        rows.append((50 + k, f"{messy.passage(600 + k)} {damaged(text, 3 * budget)}"))
    rows += [(100, None), (101, ""), (102, items[0][1].upper().replace(" ", "\n\t")), (103, "short one"), (104, messy.passage(700, 3000) + items[15][1]), (None, items[1][1]), (105, items[16][1][:450]), (106, messy.passage(800)), (106, items[2][1])]
    docs = messy.documents(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 1500):
        found = {}
        for r in decontaminate.contaminations(docs, bench, block_chars=block).collect():
            found[r["doc_id"], r["item_id"]] = r
        wanted = set()
        for d, t in rows:
            if t == "short one":
                wanted.add((d, 21))  # under 24 characters: exactly, on word bounds
            for i, text in items[:12] + [(-1, items[15][1])]:
                low, text = (t or "").lower(), text or ""
                low = " ".join(low.split())
                k = min(len(text) // 10, (len(text) + 1 - 8 - 4) // 8)
                if low and edits(text, low) <= k:
                    wanted.add((d, i))
        assert {p for p in found if p[1] != 23} == wanted and (105, 23) in found
    exact = found[None, 1]
    assert (exact["edits"], exact["start"], exact["end"]) == (0, 0, len(items[1][1]))
    text = dict((d, t) for d, t in rows)
    r = found[104, -1]
    assert text[104][r["start"] : r["end"]] == items[15][1]
    kept = decontaminate.without_contaminated(docs, bench)
    assert kept.columns == messy.COLUMNS
    bad = {(d, t) for d, t in rows if any(p[0] == d for p in found) and not (d == 106 and t == messy.passage(800))}
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id is not null").collect() if r["text"]) == sorted((d, t) for d, t in rows if d is not None and t and (d, t) not in bad)
    assert kept.where("text is null or text = ''").count() == 2
    assert decontaminate.contaminations(messy.empty(spark), bench).count() == 0 and decontaminate.contaminations(docs, bench.limit(0)).count() == 0 and decontaminate.without_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_partial_leaks_are_found(spark):
    """Any verbatim passage of WINDOW + WINDOW_STEP - 1 characters of an item, and longer ones with edits, as one span."""
    item, book = messy.passage(210, 60)[:233], messy.passage(211, 500)[:2000]
    bench = spark.createDataFrame([(1, item), (2, book)], "item_id long, text string")
    least = decontaminate.WINDOW + decontaminate.WINDOW_STEP - 1
    parts = [(1, item[:155]), (1, item[78:]), (2, book[100:500]), (2, book[-400:]), (2, book[1017:1700])]
    parts += [(2, book[at : at + least]) for at in (1, 39, 40, 41, 777, 1234, 2000 - least)]
    rows = [(k, f"{messy.passage(800 + k, 30)} | {part} | {messy.passage(900 + k, 30)}") for k, (_, part) in enumerate(parts)]
    edited = "".join("#" if k % 20 == 7 else c for k, c in enumerate(book[300:900]))
    rows += [(100, f"{messy.passage(850)} {edited}"), (101, messy.passage(851, 60) + book[500:530])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.contaminations(docs, bench).collect()}
    assert {d: r["item_id"] for d, r in found.items()} == {k: i for k, (i, _) in enumerate(parts)} | {100: 2}
    for k, (_, part) in enumerate(parts):
        at, (start, end) = rows[k][1].index(part), (found[k]["start"], found[k]["end"])
        # A window at an edge may be a hit with edits, or may be missing.
        assert found[k]["edits"] <= 16 and at - 16 <= start <= at + decontaminate.WINDOW and at + len(part) - decontaminate.WINDOW <= end <= at + len(part) + 16
    assert 25 <= found[100]["edits"] <= 38 and found[100]["end"] - found[100]["start"] > 500
    kept = {r["doc_id"] for r in decontaminate.without_contaminated(docs, bench).collect()}
    assert kept == {101}


def test_short_items_are_found_exactly(spark):
    items = [(1, "Twelve chars"), (2, "Tiny"), (3, "exactly 23 characters x"), (4, "  ")]
    rows = [(1, "so twelve  CHARS, then"), (2, "twelve charsets"), (3, "atwelve chars"), (4, " tiny\n"), (5, "tiny bits"), (6, "(exactly 23 characters x)"), (7, "exactly 23 charactets x"), (8, "twelve charsy twelve chars"), (9, "é" * 5 + "twelve chars")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["start"], r["end"]) for r in decontaminate.contaminations(docs, bench).collect()}
    assert found == {(1, 1, 3, 16), (4, 2, 1, 5), (6, 3, 1, 24), (8, 1, 14, 26)}
    assert {r["doc_id"] for r in decontaminate.without_contaminated(docs, bench).collect()} == {2, 3, 5, 7, 9}


def quoted(item, text):
    """Whether the item or one of its windows stands in the text within its edits."""
    if len(item) <= decontaminate.SEGMENT and edits(item, text) <= len(item) // 10:
        return True
    last = len(item) - 80
    return any(edits(item[at : at + 80], text) <= 8 for at in {*range(0, last, 40), *range(last, -1, -40)})


def test_a_template_shared_by_all_items():
    """Texts with a phrase of every item: what is found is what the least edit counts say, and long texts end."""
    template = messy.passage(1000, 14)[:71].strip()
    items = [(k, f"{template} {messy.passage(2000 + k, 40)}"[:191].strip()) for k in range(2000)]
    index = decontaminate.Index(items)
    texts = [template, f"{template} " * 4, f"{messy.passage(1001)} {template} {messy.passage(1002)}", items[7][1][30:], f"{template} {items[8][1][90:]} {template}"]
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        found = {i for _, i, *_ in decontaminate.find(data, np.array([0, len(data)]), index)}
        some = range(0, 8)
        assert {k for k in some if quoted(items[k][1], text)} == found & set(some)
    short = np.frombuffer((f"{template} " * 40).encode(), np.uint8)
    long = np.frombuffer((f"{template} " * 14_600).encode(), np.uint8)
    mixed = "".join(f"{template} {messy.passage(3000 + k, 20)} " for k in range(12))
    strip = lambda found: {(i, e) for _, i, e, *_ in found}
    assert strip(decontaminate.find(long, np.array([0, len(long)]), index)) == strip(decontaminate.find(short, np.array([0, len(short)]), index))
    data = np.frombuffer(mixed.encode(), np.uint8)
    whole = decontaminate.find(data, np.array([0, len(data)]), index)
    assert all(not quoted(items[k][1], mixed[:3000]) or any(i == k for _, i, *_ in whole) for k in range(6))


def test_alignment_is_the_least_edit_count():
    pick = random.Random(6)
    for _ in range(60):
        a = "".join(pick.choice("abc") for _ in range(pick.randint(1, 30)))
        b = "".join(pick.choice("abc") for _ in range(pick.randint(0, 40)))
        points = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (a, b)]
        found, start, end = decontaminate.align_one(*points, -len(a), len(b), len(a) + len(b))
        assert found == edits(a, b)


def orders_of_the_same_words(pairs, n_words=200, seed=9):
    """Texts (id, text) in pairs of similarity 0.94 or so; all have the same words, so all have one wide fingerprint."""
    pick = random.Random(seed)
    names = messy.passage(77, n_words).split()
    rows = []
    for k in range(pairs):
        one = pick.sample(names, n_words)
        two = list(one)
        at = pick.randrange(n_words - 1)
        two[at], two[at + 1] = two[at + 1], two[at]
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    return rows


@pytest.mark.parametrize("pairs", [100, 2500])
def test_near_copies_of_one_fingerprint(spark, pairs):
    """Texts of one wide fingerprint that are alike in pairs only: every pair is linked, and nothing else."""
    rows = orders_of_the_same_words(pairs)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert found == {k: k - k % 2 for k in range(2 * pairs)}


def test_near_copies_that_a_failing_link_separates(spark):
    """Families whose members all have equal words, some families beside large groups of copies: as the plain version says."""
    rows = orders_of_the_same_words(15, 60, 3)
    base = rows[0][1].split()
    for k in range(40):  # a family of copies with one swap each
        at = k % 30
        rows.append((1000 + k, " ".join([*base[:at], base[at + 1], base[at], *base[at + 2 :]])))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[d] for d, _ in rows] == brute.near_component_ids(rows)


def test_shared_counts():
    pick = np.random.default_rng(5)
    for common in (0, 3, 60):  # rare values only, and values that nearly all sets hold
        sets = [[np.unique(np.concatenate([pick.integers(0, 5000, pick.integers(0, 90)), np.arange(10_000, 10_000 + common)])) for _ in range(n)] for n in (37, 50)]
        (rows_a, a), (rows_b, b) = [(np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x)) for x in sets]
        found = simhash.shared_counts(rows_a, a, 37, rows_b, b, 50)
        assert found.tolist() == [[len(np.intersect1d(x, y)) for y in sets[1]] for x in sets[0]]
