"""Secret scans: pattern spans, and sliding-window Shannon entropy over candidate strings.

Spans come from regexp_extract_all with an anchored (gap)(match) pattern: the lengths of gaps and matches add up to
positions in code points.  A candidate is a long run of token characters; its class (hexadecimal, alphanumeric, base64)
sets the entropy that a window must reach.  A window's entropy is log2(w) - sum(n log2 n) / w; one fold over the
characters adds the entering and takes out the leaving one.  Allow-listed candidates are passed over.  Only DataFrame
functions; one scan, no shuffle.  Texts without any candidate cost only the tests for it.  All patterns are linear: none
repeats a group that may match in several ways, so long candidates neither stall nor overflow the stack.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "entropy")
#: Characters that entropy candidates consist of, their least length, and the characters in a window.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]"
WINDOW = 20
CANDIDATE = rf"(?<!{TOKEN}){TOKEN}{{{WINDOW},}}"
#: Bits per character that a window must reach, by class.
HEX_BITS, ALNUM_BITS, BASE64_BITS = 2.9, 3.6, 3.7
#: Candidates that are no secrets: UUIDs, numbers and dates; those made up of placeholders; and words joined by signs.
SHAPES = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[0-9+/_=-]+$"
PLACEHOLDER = r"(?i)example|placeholder|dummy|sample|changeme|replace|insert|password|secret|token|your|here|test|api|key|x{5,}|[0-9+/_=-]+"
#: A word is in one case or capitalised, of this many letters at most, with a vowel if longer than SHORT letters and without a run
#: of NO_WORD consonants; the words of a candidate have SHORT letters or more on average.
WORD_LETTERS, SHORT = 24, 3
WORD = rf"^([A-Z]?[a-z]{{0,{WORD_LETTERS - 1}}}|[A-Z]{{1,{WORD_LETTERS}}})$"
NO_WORD = "[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{6}"
#: Characters of a candidate that one fold walks; a longer candidate is several, overlapping by a window.
PIECE = 1 << 16

#: SQL: n log2 n for each count in a window.
_N_LOG_N = "array(" + ", ".join(f"{n * math.log2(n) if n else 0.0!r}d" for n in range(WINDOW + 2)) + ")"
#: Spans as structs whose natural order is the order of the result: by start, then kind.
_SPANS = "array<struct<start:int,kind:int,`end`:int>>"
#: Matches between which the spans found so far are set down: appending costs the spans since then, so that a text takes time in
#: proportion to its matches.
CHUNK = 256


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str, group: int | None = None) -> str:
    """SQL: array of (gap, hit, value) over the text; the last one's hit is empty."""
    whole = _lit(rf"(?s)\G(.*?)({pattern}|\z)")
    value = f"regexp_extract_all({text}, {whole}, {group})" if group else f"regexp_extract_all({text}, {whole}, 2)"
    return f"arrays_zip(regexp_extract_all({text}, {whole}, 1) as g, regexp_extract_all({text}, {whole}, 2) as h, {value} as v)".replace(" as g", "").replace(" as h", "").replace(" as v", "")


def _gathered(items: str, carried: dict[str, str], after: dict[str, str], found: str) -> str:
    """SQL: the spans that a walk over `items` (x) finds; s: what is carried from item to item (names with their first values).

    after: the carried values after an item; found: an array of the spans that it adds.
    """
    none = f"cast(array() as {_SPANS})"
    fields = lambda values: "".join(f"'{k}', {v}, " for k, v in values.items())
    step = f"named_struct({fields(after)}'found', concat(s.found, {found}))"
    inner = f"aggregate(slice(items, chunk * {CHUNK} + 1, {CHUNK}), named_struct({fields({k: f'w.{k}' for k in carried})}'found', {none}), (s, x) -> {step})"
    walked = f"element_at(transform(array({inner}), i -> named_struct({fields({k: f'i.{k}' for k in carried})}'parts', concat(w.parts, array(i.found)))), 1)"
    walk = f"aggregate(sequence(0, int((size(items) - 1) div {CHUNK})), named_struct({fields(carried)}'parts', cast(array() as array<{_SPANS}>)), (w, chunk) -> {walked}, w -> flatten(w.parts))"
    return f"element_at(transform(array({items}), items -> {walk}), 1)"


def _span(start: str, end: str, kind: int) -> str:
    return f"named_struct('start', {start}, 'kind', {kind}, 'end', {end})"


_AT = {"at": "0"}
_MOVED = {"at": "s.at + length(x.`0`) + length(x.`1`)"}


def _spans(text: str, pattern: str, kind: str, group: int | None = None) -> str:
    """SQL: the spans of the pattern's leftmost non-overlapping matches whose value is long enough."""
    span = _span("s.at + length(x.`0`)", _MOVED["at"], KINDS.index(kind))
    return _gathered(_matches(text, pattern, group), _AT, _MOVED, f"if(length(x.`2`) >= {LEAST[kind]}, array({span}), cast(array() as {_SPANS}))")


def _entropy_window(value: str, limit: str) -> str:
    """SQL: (first, last): start of the first and end of the last window of `value` that reaches `limit` bits; first < 0: none."""
    codes = f"transform(split({value}, ''), c -> instr({_lit(ALPHABET)}, c))"
    # State: counts by character (a string of one character each, 'A' for 0), sum of n log2 n, characters seen, the span so far.
    start = f"named_struct('counts', repeat('A', {len(ALPHABET)}), 'total', 0d, 'at', 0, 'first', -1, 'last', -1)"
    count = lambda at: f"(ascii(substring(s.counts, {at}, 1)) - 65)"
    log = lambda n: f"{_N_LOG_N}[{n}]"
    put = lambda counts, at, n: f"overlay({counts} placing char(65 + {n}) from {at} for 1)"
    leave = f"if(s.at >= {WINDOW}, codes[s.at - {WINDOW}], 0)"
    inner = f"transform(array(named_struct('s', s, 'c', c, 'o', {leave})), q -> named_struct('s', q.s, 'c', q.c, 'o', q.o, 'n', {count('q.c').replace('s.counts', 'q.s.counts')}, 'm', if(q.o > 0, {count('q.o').replace('s.counts', 'q.s.counts')}, 0)))"
    entered, left = f"{log('q.n + 1')} - {log('q.n')}", f"if(q.o > 0, {log('q.m - 1')} - {log('q.m')}, 0d)"
    more = put("q.s.counts", "q.c", "q.n + 1")
    # Entering and leaving the same character changes nothing.
    total = f"q.s.total + if(q.c = q.o, 0d, {entered} + {left})"
    counts = f"case when q.c = q.o then q.s.counts when q.o > 0 then {put(more, 'q.o', 'q.m - 1')} else {more} end"
    moved = f"named_struct('counts', {counts}, 'total', {total}, 'at', q.s.at + 1, 'first', q.s.first, 'last', q.s.last)"
    good = f"(r.at >= {WINDOW} and log2({WINDOW}) - r.total / {WINDOW} >= {limit} - 1e-9d)"
    marked = f"named_struct('counts', r.counts, 'total', r.total, 'at', r.at, 'first', case when {good} and r.first < 0 then r.at - {WINDOW} else r.first end, 'last', case when {good} then r.at else r.last end)"
    step = f"element_at(transform(transform({inner}, q -> {moved}), r -> {marked}), 1)"
    return f"element_at(transform(array({codes}), codes -> aggregate(codes, {start}, (s, c) -> {step}, s -> named_struct('first', s.first, 'last', s.last))), 1)"


def _span_of(value: str) -> str:
    """SQL: array of at most one (first, last): from the first to the last window of the candidate that reaches its class's bits."""
    limit = f"(case when {value} rlike '^([0-9a-f]+|[0-9A-F]+)$' then {HEX_BITS}d when {value} rlike '^[A-Za-z0-9]+$' then {ALNUM_BITS}d else {BASE64_BITS}d end)"
    piece = f"substring({value}, k * {PIECE} + 1, {PIECE + WINDOW - 1})"
    shifted = f"element_at(transform(array({_entropy_window(piece, 'bits')}), w -> if(w.first < 0, null, named_struct('first', w.first + k * {PIECE}, 'last', w.last + k * {PIECE}))), 1)"
    found = f"flatten(transform(array({limit}), bits -> filter(transform(sequence(0, int((length({value}) - 1) div {PIECE})), k -> {shifted}), w -> w is not null)))"
    return f"transform(filter(array({found}), f -> size(f) > 0), f -> named_struct('first', array_min(f).first, 'last', element_at(f, -1).last))"


def _allowed(value: str) -> str:
    """SQL: whether the candidate is on the allow-list."""
    words = f"filter(split(regexp_replace({value}, '([a-z])([A-Z])', '$1-$2'), '[-_/+=]+'), p -> p <> '')"
    word = f"p rlike {_lit(WORD)} and (length(p) <= {SHORT} or p rlike '[aeiouyAEIOUY]') and not p rlike {_lit(NO_WORD)}"
    long_enough = f"aggregate(ws, 0, (n, p) -> n + length(p)) >= {SHORT} * size(ws)"
    joined = f"{value} rlike '^[-A-Za-z_/+=]*$' and exists(array({words}), ws -> forall(ws, p -> {word}) and {long_enough})"
    return f"({value} rlike {_lit(SHAPES)} or regexp_replace({value}, {_lit(PLACEHOLDER)}, '') = '' or ({joined}))"


def _entropy_spans(text: str) -> str:
    """SQL: spans of candidates whose windows reach the bits, not allow-listed."""
    window = f"if(length(x.`1`) >= {WINDOW} and not {_allowed('x.`1`')}, {_span_of('x.`1`')}, cast(array() as array<struct<first:int,last:int>>))"
    span = _span("s.at + length(x.`0`) + w.first", "s.at + length(x.`0`) + w.last", KINDS.index("entropy"))
    return _gathered(_matches(text, CANDIDATE), _AT, _MOVED, f"transform({window}, w -> {span})")


def _outside(spans: str, base: str) -> str:
    """SQL: the spans that lie in no base span: one walk over both in order, with the furthest end of a base span so far."""
    entropy = KINDS.index("entropy")
    reach = {"reach": f"if(x.kind < {entropy}, greatest(s.reach, x.`end`), s.reach)"}
    return _gathered(f"array_sort(concat({base}, {spans}))", {"reach": "-1"}, reach, f"if(x.kind = {entropy} and x.`end` > s.reach, array(x), cast(array() as {_SPANS}))")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, entropy): one row per input row, with arrays of (start, kind, end) in code points, end exclusive.

    base is ordered by start, then kind as in KINDS (kind is the index there).  Null and empty texts have no spans; rows
    are judged one by one, so repeated ids and null ids are rows like any others.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    none = f"cast(array() as {_SPANS})"
    has = {
        "assign": F.expr(f"text rlike {_lit(ASSIGN)}"),
        "access": F.contains("text", F.lit("AKIA")),
        "hex": F.expr(f"text rlike {_lit('[0-9a-f]{32}')}"),
        "entropy": F.expr(f"text rlike {_lit(rf'(?<!{TOKEN}){TOKEN}{{{WINDOW}}}')}"),
    }
    hits = rows.withColumns({f"has_{k}": v for k, v in has.items()})
    found = {
        "assign": _spans("text", ASSIGN, "assign", 3),
        "access": _spans("text", ACCESS, "access"),
        "hex": _spans("text", HEX.replace("+", "{32,}"), "hex"),  # runs are maximal: the same spans as of shorter runs, filtered
    }
    spans = hits.withColumns({k: F.expr(f"if(has_{k}, {v}, {none})") for k, v in found.items()})
    base = spans.select("doc_id", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), F.expr(f"if(has_entropy, {_entropy_spans('text')}, {none})").alias("entropy"))
    return base.select("doc_id", "base", F.expr(f"if(size(entropy) > 0 and size(base) > 0, {_outside('entropy', 'base')}, entropy)").alias("entropy"))


def spans_text(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def secret_digests(found: DataFrame) -> DataFrame:
    """The counts, digest and span list of scan_secrets' rows."""
    every = F.array_sort(F.concat("base", "entropy"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(every).alias("spans"))


def _oracle() -> str:
    def pieces(name: str, pattern: str, value: int) -> str:
        whole = _quoted(rf"(?s)(.*?)({pattern}|\z)")
        parts = ", ".join(f"unnest(regexp_extract_all(text, {whole}, {k})) AS {c}" for k, c in ((1, "gap"), (2, "hit"), (value, "v")))
        return f"""{name} AS (SELECT r, hit, v, sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY i) AS upto
          FROM (SELECT r, {parts}, generate_subscripts(regexp_extract_all(text, {whole}, 2), 1) AS i FROM docs))"""

    words = "list_filter(regexp_split_to_array(regexp_replace(v, '([a-z])([A-Z])', '\\1-\\2', 'g'), '[-_/+=]+'), lambda p: p <> '')"
    word = f"regexp_matches(p, '{WORD}') AND (length(p) <= {SHORT} OR regexp_matches(p, '[aeiouyAEIOUY]')) AND NOT regexp_matches(p, '{NO_WORD}')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{pieces("assigns", ASSIGN, 3)}, {pieces("accesses", ACCESS, 2)}, {pieces("hexes", HEX, 2)}, {pieces("tokens", TOKEN + f"{{{WINDOW},}}", 2)},
base AS (
  SELECT r, 0 AS k, 'assign' AS kind, upto - length(hit) AS a, upto AS b FROM assigns WHERE length(v) >= {LEAST["assign"]}
  UNION ALL SELECT r, 1, 'access', upto - length(hit), upto FROM accesses WHERE length(v) >= {LEAST["access"]}
  UNION ALL SELECT r, 2, 'hex', upto - length(hit), upto FROM hexes WHERE length(v) >= {LEAST["hex"]}
), candidates AS (
  SELECT r, v, upto - length(v) AS a, CASE WHEN regexp_full_match(v, '[0-9a-f]+|[0-9A-F]+') THEN {HEX_BITS} WHEN regexp_full_match(v, '[A-Za-z0-9]+') THEN {ALNUM_BITS} ELSE {BASE64_BITS} END AS bits, {words} AS words
  FROM tokens WHERE v <> '' AND NOT regexp_matches(v, '{SHAPES}') AND regexp_replace(v, '{PLACEHOLDER}', '', 'g') <> ''
), windows AS (
  SELECT r, v, a, bits, unnest(range(0, length(v) - {WINDOW - 1})) AS i FROM candidates
  WHERE NOT (regexp_full_match(v, '[-A-Za-z_/+=]*') AND len(list_filter(words, lambda p: NOT ({word}))) = 0 AND list_sum(list_transform(words, lambda p: length(p))) >= {SHORT} * len(words))
), found AS (
  SELECT r, a + min(i) AS a, a + max(i) + {WINDOW} AS b FROM windows WHERE list_entropy(string_split(substr(v, i + 1, {WINDOW}), '')) >= bits - 1e-9 GROUP BY r, v, windows.a
), spans AS (
  SELECT * FROM base UNION ALL SELECT r, 3, 'entropy', a, b FROM found f WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = f.r AND base.a <= f.a AND base.b >= f.b)
), listed AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (r)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The digests in DuckDB's SQL: every window's entropy is counted afresh.
ORACLE = _oracle()
