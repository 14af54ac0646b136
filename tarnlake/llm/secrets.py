"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio. Native columns only.

Two first-order Markov models over ASCII characters, one of random strings and one of ordinary identifiers,
are trained from labelled samples. Their log-ratio, in thousandths of a nat, is one table of 128 x 128 whole
numbers, so that sums are exact in any engine. Candidates are long token runs with letters and digits; those
with a total above `least` are added to the spans of the fixed patterns unless they overlap one.

Spans are (kind, start, end) in code points, end exclusive. A pattern's matches are the leftmost
non-overlapping ones: `split` gives what lies between them, `regexp_extract_all` the matches, and running
sums of both lengths give the positions. Running sums, maxima and minima are taken in blocks, and text is cut out
of blocks, so that the work grows in proportion to the text however many spans it has.

Defined results: a null or empty text has no spans (the digest is that of the empty string); repeated rows
are scanned each; a null doc_id is kept; extra columns are ignored by scan() and kept by redact().
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import table


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Each as the contract gives it; {16,} and {14,} find just those matches of + that are long enough, as both
# start at a run's first character and take the whole run.
ASSIGN = "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 12
#: Thousandths of a nat: odds of a million to one for a random string.
LEAST_RATIO = 13816

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_WORDS = (
    "user name account profile request response session handler manager service client server config option value default index "
    "table column row field record document source target buffer reader writer stream parser format version release update "
    "create delete select insert count total size length width height color image video audio page section header footer title "
    "article author date time zone local global public private static final class method function module package import export "
    "test build deploy cluster driver worker executor partition shuffle memory storage network address host port path file "
    "directory folder message event listener callback error warning debug trace level group member role permission access "
    "control policy filter search query result order customer product price invoice payment shipping country region language"
).split()


def samples(n: int = 2000) -> list[tuple[str, int]]:
    """Labelled strings: label 1 for random ones (base64, hex, upper case with digits), 0 for identifiers of common words."""
    out = []
    for i in range(n):
        d = hashlib.sha256(f"random {i}".encode()).digest()
        out.append((base64.b64encode(d).decode().rstrip("=") if i % 3 == 0 else d.hex()[:40] if i % 3 == 1 else base64.b32encode(d).decode()[:24], 1))
        words = [_WORDS[d[k] % len(_WORDS)] for k in range(2 + d[9] % 3)]
        number = str(int.from_bytes(d[10:12]) % (10, 100, 1000, 10000)[d[12] % 4])
        shape = d[13] % 6
        text = (
            "_".join([*words, number]), "-".join([*words, number]), words[0] + "".join(w.title() for w in words[1:]) + number,
            "_".join(words).upper() + "_" + number, "/".join(words) + "/" + number, "".join(words),
        )[shape]
        out.append((text, 0))
    return out


def ratio_table(counts: dict[tuple[int, str, str], int]) -> list[int]:
    """128 * first + second -> thousandths of a nat by which `random` explains that step better, from step counts by label."""
    k = len(_ALPHABET)
    rows: Counter = Counter()
    for (label, a, _), n in counts.items():
        rows[label, a] += n
    out = [0] * (128 * 128)
    for a in _ALPHABET:
        for b in _ALPHABET:
            p = [(counts.get((label, a, b), 0) + 0.5) / (rows[label, a] + 0.5 * k) for label in (0, 1)]
            out[128 * ord(a) + ord(b)] = round(1000 * math.log(p[1] / p[0]))
    return out


def train(labelled: DataFrame) -> list[int]:
    """The ratio table from rows (text, label); counts are aggregated first, at most 2 x 65 x 65 of them come back."""
    steps = labelled.where("label in (0, 1)").selectExpr("cast(label as int) AS label", f"regexp_replace(text, '[^{_ALPHABET.replace('-', '')}-]', '') AS s")
    steps = steps.where("length(s) > 1").selectExpr("label", "explode(transform(sequence(1, length(s) - 1), i -> substring(s, i, 2))) AS ab")
    return ratio_table({(r["label"], r["ab"][0], r["ab"][1]): r["n"] for r in steps.groupBy("label", "ab").agg(F.count("*").alias("n")).collect()})


def default_table(spark: SparkSession) -> list[int]:
    return train(spark.createDataFrame(samples(), "text string, label int"))


_SPAN = "array<struct<s:int,k:int,e:int,v:string>>"
_BLOCK = 256  # items that one step of a running value takes
_TEXT_BLOCK = 4096  # characters
_FAR = 2147483647


def _let(value: str, name: str, body: str) -> str:
    """SQL: body, in which name stands for value."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, zero: str, step: str) -> str:
    """SQL: at each place of an array of whole numbers step(p, q) over all values up to it; step must be associative.

    Appending copies an array, so blocks are run through on their own, then the blocks' totals, and both are put together.
    """
    both = lambda p, q: step.replace("?p", p).replace("?q", q)
    start = f"named_struct('t', {zero}, 'out', cast(array() AS array<int>))"
    within = f"aggregate(b, {start}, (a, x) -> {_let(both('a.t', 'x'), 'n', "named_struct('t', n, 'out', array_append(a.out, n))")})"
    blocks = f"transform(sequence(0, greatest(0, cast(ceil(size(w) / {_BLOCK}) AS int) - 1)), i -> {_let(f'slice(w, i * {_BLOCK} + 1, {_BLOCK})', 'b', within)})"
    before = f"aggregate(d, {start}, (a, x) -> named_struct('t', {both('a.t', 'x.t')}, 'out', array_append(a.out, a.t)), a -> a.out)"
    whole = f"flatten(zip_with(d, {before}, (x, t) -> transform(x.out, v -> {both('t', 'v')})))"
    return _let(values, "w", _let(blocks, "d", whole))


def _spans(text: str, pattern: str, kind: int, value_group: int) -> str:
    """SQL for the pattern's matches in order as structs of start, kind, end and value."""
    p = "r'" + pattern + "'" if "'" not in pattern else 'r"' + pattern.replace('"', r"\x22") + '"'
    found, value = f"regexp_extract_all({text}, {p}, 0)", f"regexp_extract_all({text}, {p}, {value_group})"
    pairs = f"zip_with({found}, {value}, (m, v) -> named_struct('n', length(m), 'v', v))"
    zipped = f"filter(zip_with(split({text}, {p}, -1), {pairs}, (gap, y) -> named_struct('far', length(gap) + y.n, 'n', y.n, 'v', y.v)), z -> z.n IS NOT NULL)"
    ends = _running("transform(zs, z -> z.far)", "0", "?p + ?q")
    spans = _let(zipped, "zs", f"zip_with(zs, {ends}, (z, e) -> named_struct('s', e - z.n, 'k', {kind}, 'e', e, 'v', z.v))")
    return f"CASE WHEN {text} RLIKE {p} THEN {spans} ELSE cast(array() AS {_SPAN}) END"


def with_spans(docs: DataFrame, ratios: list[int], least: int = LEAST_RATIO) -> DataFrame:
    """docs with `_base` (spans of the fixed patterns) and `_all` (those and the models'), sorted by start, then kind."""
    ratio = f"cast(split('{','.join(map(str, ratios))}', ',') AS array<int>)"
    text = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    found = text.withColumns({
        "_assign": F.expr(f"filter({_spans('_t', ASSIGN, 0, 2)}, x -> length(x.v) >= {LEAST_VALUE})"),
        "_access": F.expr(_spans("_t", ACCESS, 1, 0)),
        "_hex": F.expr(_spans("_t", HEX, 2, 0)),
        "_long": F.expr(f"filter({_spans('_t', CANDIDATE, 3, 0)}, x -> x.v RLIKE '[0-9]' AND x.v RLIKE '[A-Za-z]')"),
    }).drop("_t")
    based = found.withColumn("_base", F.expr("array_sort(concat(_assign, _access, _hex))")).drop("_assign", "_access", "_hex")
    # Candidates clear of the fixed patterns: in order of start, none of those before ends within, nor does the next after begin there.
    last_end = _running("transform(every, x -> if(x.k < 3, x.e, 0))", "0", "greatest(?p, ?q)")
    next_start = f"reverse({_running(f'transform(reverse(every), x -> if(x.k < 3, x.s, {_FAR}))', str(_FAR), 'least(?p, ?q)')})"
    joined = f"zip_with(every, zip_with({last_end}, {next_start}, (p, n) -> named_struct('p', p, 'n', n)), (x, o) -> named_struct('x', x, 'clear', x.k = 3 AND o.p <= x.s AND o.n >= x.e))"
    clear = _let("array_sort(concat(_base, _long))", "every", f"transform(filter({joined}, y -> y.clear), y -> y.x)")
    codes = "transform(split(x.v, ''), c -> ascii(c))"
    total = f"aggregate({codes}, named_struct('last', 0, 'sum', 0L), (a, c) -> named_struct('last', c, 'sum', a.sum + if(c = 0, 0, element_at({ratio}, 128 * a.last + c + 1))), a -> a.sum)"
    clear = f"CASE WHEN size(_long) = 0 OR size(_base) = 0 THEN _long ELSE {clear} END"
    more = f"CASE WHEN size(_long) = 0 THEN _long ELSE filter({clear}, x -> {total} >= {least}) END"
    return based.withColumn("_more", F.expr(more)).drop("_long").withColumn("_all", F.expr("array_sort(concat(_base, _more))")).drop("_more")


def _joined(spans: str) -> str:
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat(element_at({names}, x.k + 1), ':', x.s, ':', x.e)), ',')"


def scan(docs: DataFrame, ratios: list[int] | None = None, least: int = LEAST_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    ratios = ratios or default_table(docs.sparkSession)
    count = lambda k: f"cast(size(filter(_all, x -> x.k = {k})) AS bigint)"
    return with_spans(docs.select("doc_id", "text"), ratios, least).selectExpr(
        "doc_id", f"{count(0)} AS n_assign", f"{count(1)} AS n_access", f"{count(2)} AS n_hex", f"{count(3)} AS n_markov",
        f"sha2({_joined('_base')}, 256) AS base_sha256", f"{_joined('_all')} AS spans",
    )


def redact(docs: DataFrame, ratios: list[int] | None = None, least: int = LEAST_RATIO, mark: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping spans replaced by `mark`, and n_chars, where there is one, counted again."""
    ratios = ratios or default_table(docs.sparkSession)
    n = _TEXT_BLOCK

    def cut(a: str, b: str) -> str:
        """The characters from a to b (exclusive), out of the blocks `t`."""
        first, last = f"({a} DIV {n})", f"(({b} - 1) DIV {n})"
        within = f"substring(t[{first}], {a} % {n} + 1, {b} - {a})"
        across = f"concat(substring(t[{first}], {a} % {n} + 1), array_join(slice(t, cast({first} + 2 AS int), cast({last} - {first} - 1 AS int)), ''), left(t[{last}], cast({b} - {last} * {n} AS int)))"
        return f"CASE WHEN {b} <= {a} THEN '' WHEN {first} = {last} THEN {within} ELSE {across} END"

    # What lies before a span that no earlier one reaches is kept, with the mark after it; the rest of a run of overlapping spans adds nothing.
    far = _running("transform(_all, x -> x.e)", "0", "greatest(?p, ?q)")
    kept = f"zip_with(_all, zip_with(slice(concat(array(0), far), 1, size(far)), far, (p, e) -> p), (x, p) -> CASE WHEN x.s < p THEN '' ELSE concat({cut('p', 'x.s')}, '{mark}') END)"
    new = _let(f"regexp_extract_all(text, '(?s).{{1,{n}}}', 0)", "t", _let(far, "far", f"concat(array_join({kept}, ''), {cut('array_max(far)', 'length(text)')})"))
    out = with_spans(docs, ratios, least).withColumn("text", F.expr(f"CASE WHEN size(_all) = 0 THEN text ELSE {new} END"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in docs.columns))


def op9(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def _sql() -> str:
    counts: Counter = Counter()
    for text, label in samples():
        counts.update((label, a, b) for a, b in zip(text, text[1:], strict=False))
    ratio = "[" + ",".join(map(str, ratio_table(counts))) + "]"
    quote = lambda p: "'" + p.replace("'", "''") + "'"

    def spans(pattern: str, kind: int, group: int, where: str) -> str:
        q = quote(pattern)
        return f"""SELECT n, {kind} AS k, v, s, s + length(m) AS e FROM (
            SELECT n, f[i] AS m, g[i] AS v, list_sum(list_transform(gaps[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(f[1:i-1], lambda z: length(z))), 0) AS s
            FROM (SELECT n, gaps, f, g, unnest(range(1, len(f) + 1)) AS i FROM (
                SELECT n, string_split_regex(t, {q}) AS gaps, regexp_extract_all(t, {q}, 0) AS f, regexp_extract_all(t, {q}, {group}) AS g FROM d WHERE regexp_matches(t, {q})))) WHERE {where}"""

    names = "CASE k WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'markov' END"
    total = "list_sum(list_transform(range(1, length(v)), lambda i: r[128 * ord(substr(v, CAST(i AS INT), 1)) + ord(substr(v, CAST(i AS INT) + 1, 1)) + 1]))"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents),
base AS ({spans(ASSIGN, 0, 2, f"length(v) >= {LEAST_VALUE}")} UNION ALL {spans(ACCESS, 1, 0, "true")} UNION ALL {spans(HEX, 2, 0, "true")}),
long AS ({spans(CANDIDATE, 3, 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')")}),
more AS (SELECT n, k, v, s, e FROM long, (SELECT {ratio} AS r) WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.n = long.n AND b.s < long.e AND long.s < b.e) AND {total} >= {LEAST_RATIO}),
al AS (SELECT n, count(*) FILTER (k = 3) AS n_markov, string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM (SELECT n, k, s, e FROM base UNION ALL SELECT n, k, s, e FROM more) GROUP BY n),
b AS (SELECT n, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM base GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_markov, 0) AS n_markov,
    sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(al.spans, '') AS spans
FROM d LEFT JOIN b USING (n) LEFT JOIN al USING (n)
"""


ORACLE = _sql()
