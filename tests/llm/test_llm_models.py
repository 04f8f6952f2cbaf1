"""Chat formatting, language ID, token ids and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from llm import brute, messy
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from foldlight.llm import bpe, chat, langid, queries, repair, tokenids
from foldlight.llm import textkernel as tk

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def turns(spark):
    return spark.read.parquet(f"{SF}/conversations.parquet")


@pytest.fixture(scope="module")
def hmm(turns):
    return chat.fit(turns)


def sequential(rows, model):
    """Turns of one transcript, decoded at once; rows: texts with their turn numbers."""
    at, names, lines, emissions = chat.observations([t for _, t in rows], model)
    states, out = chat.viterbi(emissions, model.start, model.step), []
    for k, s in enumerate(states):
        if s % 2 == 0 or not out:
            out.append([rows[at[k]][0], chat.ROLES[s // 2], [lines[k]]])
        else:
            out[-1][2].append(lines[k])
    return [(a, b, "\n".join(c)) for a, b, c in out]


def joined(found):
    return [(r["turn"], r["role"], r["text"]) for r in found]


def test_parse_line():
    assert chat.parse_line("User: hi") == (1, "user", "hi") and chat.parse_line("<|assistant|> x") == (2, "assistant", "x") and chat.parse_line("**System**: y") == (0, "system", "y")
    assert chat.parse_line("Note: hi") == (-1, "", "Note: hi") and chat.parse_line("") == (-1, "", "")
    assert chat.parse_line("<|function|>z") == (3, "function", "z") and chat.parse_line("Developer: z") == (0, "developer", "z") and chat.parse_line("<|The Narrator|> z") == (4, "the narrator", "z")


def line_chances(text, model):
    """Of each line by state, written out from the model's numbers; markers as in the test's own transcripts."""
    names = {"system": 0, "user": 1, "assistant": 2, "tool": 3}
    out = []
    for j, line in enumerate(text.split("\n")):
        said = next((r for name, r in names.items() if line.startswith(f"<|{name}|> ")), None)
        bare = line.split("|> ", 1)[1] if said is not None else line
        feature = 2 * min(len(bare).bit_length(), 7) + bare.rstrip().endswith("?")
        row = []
        for r in range(5):
            begins = 0.15 if said is None else 0.85 * (0.9995 if said == r else 0.0005 / 4)
            inside = 0.998 if said is None else 0.002 / 5
            row.append(np.log(begins * (0.97 if j == 0 else 0.03)) + model.feature[r, feature])
            row.append(np.log(inside * (0.03 if j == 0 else 0.97)) + model.feature[r, feature])
        out.append(row)
    return out


def test_viterbi_is_the_best_path(spark, hmm):
    """All state sequences of short transcripts, scored one by one."""
    import itertools

    pick = random.Random(1)
    for k in range(6):
        lines = [pick.choice(["<|user|> ", "<|assistant|> ", "<|tool|> ", "", ""]) + pick.choice(["why?", "it is so", "x" * 40, ""]) for _ in range(4)]
        texts, cut = ["\n".join(lines[:2]), "\n".join(lines[2:])], 0
        chances = [c for t in texts for c in line_chances(t, hmm)]
        score = lambda s: hmm.start[s[0]] + chances[0][s[0]] + sum(hmm.step[a, b] + chances[i][b] for i, (a, b) in enumerate(itertools.pairwise(s), 1))  # noqa: B023, E731
        best = max(itertools.product(range(10), repeat=4), key=score)
        _, _, _, emissions = chat.observations(texts, hmm)
        assert np.allclose(emissions, chances)
        assert score(chat.viterbi(emissions, hmm.start, hmm.step)) == pytest.approx(score(best))
        talk = spark.createDataFrame([(k, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string")
        found = chat.parse_transcripts(talk, hmm).orderBy("turn", "piece").collect()
        wanted = [chat.ROLES[s // 2] for i, s in enumerate(best) if s % 2 == 0 or i == 0]
        assert joined(found) and [r["role"] for r in found] == wanted
    whole = chat.transfer(emissions, hmm.step)
    halves = (chat.transfer(emissions[:2], hmm.step)[:, :, None] + chat.transfer(emissions[2:], hmm.step)[None]).max(axis=1)
    assert np.allclose(whole, halves)


def test_roles_of_the_query(spark, turns):
    """Roles of rows without a marker, by a model of other conversations."""
    truth = {(r["conv_id"], r["turn"]): r["role"] for r in turns.collect()}
    hidden = {(r["conv_id"], r["turn"]) for r in turns.where(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) == 0).collect()}
    found = {(r["conv_id"], r["turn"]): r["role"] for r in queries.op1_chat_format(spark, SF).collect() if r["piece"] == 0}
    right = sum(found.get(k) == truth[k] for k in hidden)
    print(f"roles of hidden rows: {right} of {len(hidden)} right")
    assert right >= 0.95 * len(hidden) and all(found.get(k) == r for k, r in truth.items() if k not in hidden)


def test_unknown_speakers_keep_their_names(spark, hmm):
    rows = [(1, 0, "Narrator", "It was night."), (1, 1, "user", "hello"), (1, 2, "function", "{}"), (1, 3, "the |odd\none", "x"), (1, 4, "", "more")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.parse_transcripts(talks, chat.fit(talks), marker="role").orderBy("turn").collect()
    assert [r["role"] for r in found][:4] == ["narrator", "user", "tool", "the  odd one"] and found[0]["rendered"] == "<|narrator|>\nIt was night.\n"


def test_roles_with_all_and_with_some_markers(turns, hmm):
    truth = {(str(r["conv_id"]), r["turn"]): r["role"] for r in turns.collect()}
    found = chat.parse_transcripts(turns, hmm, marker="role").collect()
    assert {(r["conv"], r["turn"]): r["role"] for r in found} == truth
    some = turns.withColumn("name", F.when(F.xxhash64("conv_id", "turn") % 3 != 0, F.col("role")))
    held = turns.where("conv_id % 2 = 0")  # fitted on one half, tried on the other
    found = chat.parse_transcripts(some.where("conv_id % 2 = 1"), chat.fit(held), marker="name").collect()
    right = sum(truth.get((r["conv"], r["turn"])) == r["role"] for r in found)
    assert right >= 0.97 * sum(int(c) % 2 == 1 for c, _ in truth)


@pytest.mark.parametrize("partitions", [1, 7])
def test_a_cut_transcript_is_decoded_as_a_whole(spark, turns, hmm, partitions):
    one = turns.select(F.lit(1).alias("conv_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("turn"), F.when(F.xxhash64("turn", "conv_id") % 4 != 0, F.col("role")).alias("name"), "text")
    rows = [(r["turn"], f"<|{r['name']}|> {r['text']}" if r["name"] else r["text"]) for r in one.orderBy("turn").collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        found = chat.parse_transcripts(one, hmm, marker="name").orderBy("turn", "piece").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert joined(found) == sequential(rows, hmm)
    assert sum(r["n_lines"] for r in found) == sum(t.count("\n") + 1 for _, t in rows)


def test_odd_transcripts(spark, hmm):
    rows = [(1, 0, "user", None, "x"), (1, 1, None, "", "x"), (1, 1, None, "", "x"), (None, 0, "assistant", "hi\nUser: yo\nAssistant: " + "long " * 5000, "x"), (2, None, "nobody", "a\n\nb", "x"), (3, 5, "ai", "q", "x")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string")
    found = chat.parse_transcripts(talks, hmm, marker="role").orderBy("conv", "turn", "piece").collect()
    by = {}
    for r in found:
        by.setdefault(r["conv"], []).append(r)
    assert [r["role"] for r in by[None]] == ["assistant", "user", "assistant"] and by[None][1]["rendered"] == "<|user|>\nyo\n"
    assert [r["role"] for r in by["3"]] == ["assistant"] and sum(r["n_lines"] for r in by["1"]) == 3 and sum(r["n_lines"] for r in by["2"]) == 3
    assert chat.parse_transcripts(talks.limit(0), hmm, marker="role").count() == 0 and chat.fit(talks.limit(0)).step.shape == (10, 10)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_of_held_out_documents(docs):
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    held = langid.document_rows(docs.where("doc_id % 2 = 1 and n_chars >= 40"))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = langid.identify(held, model).collect()
    assert sum(truth[r["id"]] == r["lang"] for r in found) >= 0.98 * len(found)


def test_rare_languages_stay_in_a_large_table(spark, docs):
    """A label's texts are in the model however many others there are, and no label goes by its rank."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = [(f"x{k:02}", " ".join(letters[(k + j) % 26] + letters[(7 * k + j * j) % 26] + letters[k // 26 + 3] for j in range(40)) + f" {n}") for k in range(70) for n in range(2)]
    common = docs.where("lang is not null and text is not null").select("lang", "text")
    names = {r["lang"] for r in common.select("lang").distinct().collect()} | {x for x, _ in rare}
    table = common.unionByName(spark.createDataFrame(rare, "lang string, text string"))
    model = langid.fit(table, rows=10)
    assert set(model.languages) == names
    rows = spark.createDataFrame([(k, text, None, None, None, None) for k, (_, text) in enumerate(rare)], "id long, text string, declared string, host string, domain string, suffix string")
    found = {r["id"]: r["text_lang"] for r in langid.identify(rows, model).collect()}
    assert [found[k] for k in range(len(rare))] == [x for x, _ in rare]


def test_scores_are_sums_of_table_entries(docs):
    import pyarrow as pa

    model = langid.fit(docs)
    texts = ["The quick", "", None, "öde Straße", "1234", "ab"]
    n, scores = model.scores(*tk.text_bytes(pa.array(texts)))
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        seen = bytes(langid._LETTERS[np.frombuffer(raw, np.uint8)])
        grams = [seen[i : i + 3] for i in range(len(seen) - 2)]
        grams = [g for g in grams if not (g[1] == 32 and (g[0] == 32 or g[2] == 32))]
        assert n[k] == len(grams)
        total = []
        for table in model.tables:
            b = [((g[0] * 0x9E3779B1 & 0xFFFFFFFF) ^ (g[1] * 0x85EBCA77 & 0xFFFFFFFF) ^ (g[2] * 0xC2B2AE3D & 0xFFFFFFFF)) * 0x27D4EB2F % (1 << 32) >> 16 for g in grams]
            total.append(sum(int(table[x]) for x in b) / langid._SCALE)
        weight = langid.TEXT_WEIGHT / (langid.TEXT_WEIGHT + len(grams))
        assert scores[k] == pytest.approx([(x - max(total)) * weight for x in total])


def test_evidence_decides_where_the_text_cannot(spark, docs):
    model = langid.fit(docs)
    rows = [(k, "kkk www", None, "h1.fr.example", "fr.example", None) for k in range(3)] + [(10, "kkk", "de", None, None, None), (11, "kkk", None, None, None, "es"), (12, None, "de", None, None, None), (13, "123 !!", "de", None, None, "de"), (14, "kkk", "xx", None, None, "yy")]
    real = [(100 + k, r["text"], None, "h2.fr.example", "fr.example", None) for k, r in enumerate(docs.where("lang = 'fr'").limit(80).collect())]
    real += [(1000 + k, r["text"], None, None, None, None) for k, r in enumerate(docs.where("lang <> 'fr'").limit(300).collect())]
    frame = spark.createDataFrame(rows + real, "id long, text string, declared string, host string, domain string, suffix string")
    found = {r["id"]: r for r in langid.identify(frame, model).collect()}
    assert [found[k]["lang"] for k in (0, 1, 2)] == ["fr"] * 3, "the domain's prior"
    assert found[10]["lang"] == "de" and found[11]["lang"] == "es"
    assert found[12]["lang"] is None and not found[12]["kept"] and found[13]["lang"] is None and found[14]["lang"] is not None
    assert langid.identify(frame.limit(0), model).count() == 0
    unknown = langid.fit(docs.limit(0))
    assert langid.identify(frame, unknown).where("kept").count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, "https://Shop.example.de/x?y=1", '<html lang="de-AT"><head><title>t</title></head><p>Das <b>ist</b></p><script>var x = "<p>";</script><!-- no -->', "x"), (2, None, None, "x"), (3, "http://a.b.example.com/fr/1", "plain", "x")], "page_id long, url string, html string, id string")
    found = {r["id"]: r for r in langid.page_rows(pages).collect()}
    assert (found[1]["declared"], found[1]["host"], found[1]["domain"], found[1]["suffix"]) == ("de", "shop.example.de", "example.de", "de") and found[1]["text"].split() == ["t", "Das", "ist"]
    assert found[2]["text"] is None and found[2]["host"] is None and found[3]["suffix"] == "fr" and found[3]["domain"] == "example.com"
    query = queries.op7_language_id(spark, SF)
    assert query.count() == 1250 and query.where("doc_id is not null").count() == 1000
    truth = {r["page_id"]: r["declared"] for r in langid.page_rows(spark.read.parquet(f"{SF}/pages.parquet")).withColumnRenamed("id", "page_id").collect()}
    assert all(truth[r["page_id"]] == r["lang"] for r in query.where("page_id is not null").collect())


def test_visible_text():
    import time

    see = lambda html: (" ".join((langid.visible_text(html)[0] or "").split()), langid.visible_text(html)[1])
    assert see('<!DOCTYPE html><HTML class="x" LANG=\'fr-CA\'><style>p{}</style>a < b &amp; 3<4 <b>c</b><!-- <p>x</p> --> d') == ("a < b &amp; 3 <4 c d", "fr")
    assert see('<script>if (a<b) {"<p>"}</script>x<SCRIPT src="y">z') == ("x", None) and see("<!-- open <p>x") == ("", None) and see("<html><body lang=de>x") == ("x", None)
    assert langid.visible_text(None) == (None, None) and see("") == ("", None)
    for page in ("<" * 1_000_000, "<!--" * 250_000, "<script" * 150_000, "<html lang" * 100_000, "<a " * 300_000 + ">"):
        began = time.perf_counter()
        langid.visible_text(page)
        assert time.perf_counter() - began < 2


def test_fusion_is_the_product_of_its_evidence(spark):
    """fuse() against the posterior written out for each row."""
    import math

    languages, pick = ["EN", "de", "fr"], random.Random(8)
    rows = []
    for k in range(120):
        n = pick.choice([0, 1, 30])
        scores = [round(pick.uniform(-4, 0), 3) for _ in languages] if n else [0.0] * 3
        scores[pick.randrange(3)] = 0.0
        host = pick.choice([None, "a.x.de", "b.x.de", "c.y.fr"])
        rows.append((k, n, scores, host, host and host[2:], pick.choice([None, "en", "fr", "xx"]), pick.choice([None, "de", "zz"])))
    frame = spark.createDataFrame(rows, "id long, trigrams long, loglik array<double>, host string, domain string, declared string, suffix string")
    found = {r["id"]: r for r in langid.fuse(frame, languages).collect()}
    text = {r[0]: languages[r[2].index(max(r[2]))] if r[1] and r[2].count(max(r[2])) == 1 else None for r in rows}
    assert all(found[k]["text_lang"] == text[k] for k in text)
    count = lambda keep: [sum(text[r[0]] == x and keep(r) for r in rows) for x in languages]
    shrink = lambda own, parent, strength: [(n + strength * p) / (sum(own) + strength) for n, p in zip(own, parent, strict=True)]
    whole = shrink(count(lambda r: True), [1 / 3] * 3, 1)
    for k, n, scores, host, domain, declared, suffix in rows:
        prior = whole
        if host:
            prior = shrink(count(lambda r, d=domain: r[4] == d), prior, langid.DOMAIN_STRENGTH)
            prior = shrink(count(lambda r, h=host: r[3] == h), prior, langid.HOST_STRENGTH)
        total = [s + math.log(p) for s, p in zip(scores, prior, strict=True)]
        for said, share in ((declared, langid.DECLARED_TRUST), (suffix, langid.SUFFIX_TRUST)):
            if said in ("en", "de", "fr"):
                total = [t + math.log(share if x.lower() == said else (1 - share) / 2) for t, x in zip(total, languages, strict=True)]
        best = languages[total.index(max(total))] if n else None
        assert found[k]["lang"] == best
        if best:
            assert found[k]["probability"] == pytest.approx(1 / sum(math.exp(t - max(total)) for t in total), abs=2e-6)


def test_accepted_keeps_columns_and_clean_rows(spark, docs):
    messy_docs = messy.documents(spark)
    kept = langid.accepted(messy_docs, langid.fit(docs))
    assert kept.columns == messy.COLUMNS
    gone = {r["row"] for r in messy_docs.collect()} - {r["row"] for r in kept.collect()}
    assert gone == {k for k, (_, t) in enumerate(messy.texts()) if not any(c.isalpha() for c in t or "")}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenids.default_vocabulary())


def test_encoder_equals_the_library(tokenizer):
    import pyarrow as pa

    pick = random.Random(1)
    pieces = ["'", "s", "t", "re", "ve", " ", "  ", "\n", "\r\n", "a", "é", "1", "²", "!", "'s", "'ll", "d", "\t", "“", " ", "漢", "­", "x'", "¿", "ª", "😀", "<|endoftext|>", "<|", "'S", "İ"]
    texts = ["".join(pick.choice(pieces) for _ in range(pick.randint(0, 14))) for _ in range(4000)]
    found = bpe.Encoder(tokenids.default_vocabulary(), keep=500)
    for at in range(0, len(texts), 800):
        some = texts[at : at + 800]
        ids, offsets = found.encode(*tk.text_bytes(pa.array(some)))
        wanted = [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == wanted


@pytest.mark.parametrize("seed", range(5))
def test_grammar_round_trip(seed):
    pick = np.random.default_rng(seed)
    counts = pick.integers(0, 400, 60)
    if seed == 1:
        counts[:] = 0
    ids = pick.zipf(1.4, counts.sum()) % 50 if seed != 2 else np.ones(counts.sum(), np.int64)
    ids = ids.astype(np.uint32)
    rules, lengths, symbols, symbol_counts = repair.compress(ids, counts, 1 << 17, rounds=12, least=4)
    assert np.array_equal(repair.expand(symbols, rules, lengths, 1 << 17), ids)
    assert len(symbols) <= len(ids) and (not counts.sum() or len(rules))
    ends = np.cumsum(counts)
    for k in range(60):
        mine = ids[ends[k] - counts[k] : ends[k]]
        assert np.array_equal(repair.expand_document(k, symbols, symbol_counts, rules, lengths, 1 << 17), mine)
        assert np.array_equal(repair.expand_document(k, symbols, symbol_counts, rules, lengths, 1 << 17, 5, 17), mine[5:17])


def pair_counts(symbols, symbol_counts):
    """Occurrences of each pair that do not overlap, inside documents."""
    found, at = {}, 0
    for n in symbol_counts.tolist():
        mine, skip, last = symbols[at : at + n].tolist(), False, None
        for a, b in zip(mine, mine[1:], strict=False):
            skip = a == b and last == (a, b) and not skip
            found[a, b] = found.get((a, b), 0) + (not skip)
            last = a, b
        at += n
    return found


def test_no_frequent_pair_is_left():
    """Equal copies with a multiple of eight pairs each: every pair counts at every place, and rounds go on to the end."""
    copies = np.tile(np.arange(1, 66, dtype=np.uint32), 60)
    pick = np.random.default_rng(3)
    mixed = (pick.zipf(1.2, 60_000) % 3000).astype(np.uint32)
    for ids, counts in ((copies, np.full(60, 65)), (mixed, np.full(60, 1000)), (np.ones(5000, np.uint32), np.array([4000, 1000]))):
        rules, lengths, symbols, symbol_counts = repair.compress(ids, counts, 1 << 17)
        assert np.array_equal(repair.expand(symbols, rules, lengths, 1 << 17), ids)
        assert max(pair_counts(symbols, symbol_counts).values(), default=0) < repair.MIN_COUNT
    rules, lengths, symbols, _ = repair.compress(copies, np.full(60, 65), 1 << 17)
    assert len(symbols) == 60 and lengths.max() == 65
    # The first rule is the most frequent pair of all places.
    ids = np.concatenate([mixed, np.tile(np.array([4000, 4001], np.uint32), 5000)])
    rules = repair.compress(ids, np.array([60_000, *[2] * 5000]), 1 << 17)[0]
    assert rules[0].tolist() == [4000, 4001]


def encoded(rows, tokenizer):
    """rows in order; (doc_id, start, n_tokens, crc)."""
    out, start = [], 0
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))


def test_token_ids(spark, tokenizer, docs, monkeypatch):
    rows = in_order(messy.texts())
    assert sorted((tuple(r) for r in tokenids.encoded_documents(messy.documents(spark)).collect()), key=lambda r: r[1]) == encoded(rows, tokenizer)
    some = docs.where("doc_id < 200")
    wanted = encoded([(r["doc_id"], r["text"]) for r in some.orderBy("doc_id").collect()], tokenizer)
    assert sorted(tuple(r) for r in tokenids.encoded_documents(some).collect()) == wanted
    assert tokenids.encoded_documents(messy.empty(spark)).count() == 0


def test_pipeline(spark, tokenizer, tmp_path):
    """All stages against plain versions, on documents with copies, leaks and junk."""
    bench = [(k, messy.passage(900 + k, 30)) for k in range(3)]
    rows = [(k, messy.passage(k, 20 + k), "en" if k % 2 else "de", f"s{k % 4}") for k in range(40)]
    rows += [(100, rows[3][1], "en", "s1"), (101, rows[4][1], "de", "s0"), (102, "### 123 !!", "en", "s0"), (103, None, "en", None), (104, "", None, "s1"), (105, f"{messy.passage(50)} {bench[1][1]}", "en", "s2"), (106, rows[7][1].replace(" ", "\n"), "en", None), (107, messy.passage(51, 200), "en", None), (108, f"{messy.passage(51, 200)} one more word", "de", "s3")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    ids = brute.near_component_ids([(r[0], r[1]) for r in kept])
    kept = [r for r, c in zip(kept, ids, strict=True) if r[0] == c]
    kept = [r for r in kept if r[0] != 105]
    assert {r[0] for r in rows} - {r[0] for r in kept} == {100, 101, 102, 103, 104, 105, 106, 108}
    taken = {d: (t // z if z else 0) for d, _, z, _, _, t in brute.mix([(r[0], r[1], r[3]) for r in kept])}
    mixed = in_order([(r[0], r[1]) for r in kept for _ in range(taken[r[0]])])
    found = sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert found == encoded(mixed, tokenizer)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mix", "token_ids"]


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_marker_of_long_blanks_is_linear():
    import time

    began = time.perf_counter()
    for line in (" " * 1_000_000 + "!", "a" + " " * 1_000_000, "[(" + " " * 1_000_000 + "a" + " " * 1_000_000 + "]", "<|" + "x" * 1_000_000, "\t" * 1_000_000 + "user :  hi", "a" * 1_000_000):
        chat.parse_line(line)
    assert time.perf_counter() - began < 1
    assert chat.parse_line(" " * 1000 + "[user] :  hi") == (1, "user", "hi") and chat.parse_line("** User ** : x") == (1, "user", "x")


def test_rows_do_not_depend_on_the_partitions(spark, hmm):
    """Turns that go on over many rows: one row each, wherever partitions end."""
    talk = [(1 + k // 40, k, ("<|user|> why?" if k % 2 else "<|assistant|> it is so") if k % 5 == 0 else f"and so on {k}\nmore") for k in range(120)]
    rows = spark.createDataFrame(talk, "conv_id long, turn long, text string")
    sticky = chat.Hmm(hmm.start, hmm.step + np.where(np.arange(10) % 2 == 0, np.log(0.002), 0.0), hmm.feature)  # turns seldom end
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    found = []
    try:
        for n in (1, 16, 97):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, chat.parse_transcripts(rows, sticky).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert found[0] == found[1] == found[2] and sum(r[4] for r in found[0]) == sum(t.count("\n") + 1 for *_, t in talk) and any(r[4] > 6 for r in found[0])
