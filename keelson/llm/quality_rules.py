"""Operator 5: a threshold table compiled into one projection.

``RULES`` is the table: a metric, its lower and its upper bound.  ``compile_rules``
turns it into one boolean expression; ``measure`` turns a text column into the
metrics.  Only built-in functions are used, nothing is shuffled and nothing is
exploded: repeats are found inside the row by sorting its windows, so a long
document costs n log n in its own row and no key can become hot.

Defined results: a null text counts as the empty text (zero words, hence
``base_failed``); a null ``doc_id`` and repeated rows pass through row by row; an
empty table gives an empty table; a very long text is measured whole, whatever its
length (n log n in its words); further input columns are kept by ``apply_rules``,
and a metric wins over an input column of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.shared import SPACE, let

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for as on was at by this are or an from "
    "der die das und ist von den zu mit sich des auf für nicht ein eine im dem auch "
    "le la les de des et en un une du que est pour qui dans au par sur pas "
    "el los las y por con para una no se del al lo como su es"
).split()

#: (metric, least, most); None leaves a side open.  Ratios are per word.
RULES = (
    ("n_words", 20, None),
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.25),
    ("shout_ratio", None, 0.25),
    ("stop_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
)

WINDOW = 8


def word_array(text: Column) -> Column:
    """Words of a non-null text, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated(tagged: Column, kind: str) -> Column:
    """Sorted places ``i`` of the entries (w, i) whose ``w``, of type ``kind``, another entry has too."""

    def runs(s: Column) -> Column:
        none = F.array(F.lit(None).cast(f"struct<w:{kind},i:int>"))
        before = F.concat(none, F.slice(s, 1, F.size(s) - 1))
        after = F.concat(F.slice(s, 2, F.size(s) - 1), none)
        near = F.arrays_zip(s.alias("s"), before.alias("b"), after.alias("a"))
        same = lambda x, side: x["s"]["w"].eqNullSafe(x[side]["w"])
        hit = F.filter(near, lambda x: same(x, "b") | same(x, "a"))
        return F.sort_array(F.transform(hit, lambda x: x["s"]["i"]))

    return let(F.sort_array(tagged), runs)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words, a power of two, found twice or more in ``words``.

    Each word is hashed once, and hashes are joined pairwise to those of 2, 4 and 8 words.  Only a text whose hashes
    repeat is looked at further: half a hash and its place make one number, and neighbours in the order of these are
    compared word by word.  Should two of them be no equal windows after all, all windows are compared as texts."""

    def hashes(ws: Column) -> Column:
        def doubling(span: int):
            return lambda h: F.transform(F.slice(h, 1, F.size(h) - span), lambda x, i: F.xxhash64(x, F.get(h, i + span)))

        out, span = F.transform(ws, lambda w: F.xxhash64(w)), 1
        while span < window:
            out = let(out, doubling(span))
            span *= 2
        return out

    def covered(starts: Column) -> Column:
        # Every start covers ``window`` words, less what the next start covers too.
        steps = lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
        return let(starts, lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(steps(p), F.lit(0), lambda n, x: n + x)))

    # Indexed reads of a bound array are constant time; slice() would copy the whole array for each window.
    def as_texts(ws: Column, h: Column) -> Column:
        text = lambda i: F.concat_ws(" ", *(F.get(ws, i + k) for k in range(window)))
        return covered(repeated(F.transform(h, lambda x, i: F.struct(text(i).alias("w"), i.alias("i"))), "string"))

    def by_neighbours(ws: Column, h: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        high = lambda x: F.shiftright(x, 32)

        def equal(x: Column, y: Column) -> Column:
            words = F.lit(True)
            for k in range(window):
                words &= F.get(ws, place(x) + k) == F.get(ws, place(y) + k)
            return F.when(high(x) != high(y), 0).when(words, 1).otherwise(-1)

        def found(s: Column) -> Column:
            pairs = F.transform(F.slice(s, 1, F.size(s) - 1), lambda x, i: equal(x, F.get(s, i + 1)))
            hit = lambda q, i: F.coalesce(F.get(q, i) == 1, F.lit(False))
            starts = lambda q: F.filter(F.transform(s, lambda x, i: F.when(hit(q, i) | hit(q, i - 1), place(x))), lambda x: x.isNotNull())
            return let(pairs, lambda q: F.when(F.array_contains(q, F.lit(-1)), as_texts(ws, h)).otherwise(covered(F.sort_array(starts(q)))))

        return let(F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, 32).bitwiseOR(i.cast("bigint")))), found)

    def of_words(ws: Column) -> Column:
        return let(hashes(ws), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(by_neighbours(ws, h)))

    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(words, of_words)).cast("long")


def measure(text: Column) -> Column:
    """All metrics of one text as a struct; null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def of_words(t: Column) -> Column:
        return let(word_array(t), lambda ws: metrics(t, ws))

    def metrics(t: Column, ws: Column) -> Column:
        n = F.size(ws)
        per = lambda x: x / F.greatest(n, F.lit(1))
        chars = F.length(F.translate(t, " \t\n\x0b\f\r", ""))
        symbols = F.regexp_count(t, F.lit("[#*$%&|<>]"))
        shouts = (F.length(t) - F.length(F.replace(t, F.lit("!!"), F.lit("")))) / 2
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        stops = F.size(F.filter(ws, lambda w: F.lower(w).isin(STOP_WORDS)))
        return let(
            F.struct(F.size(lines).alias("all"), F.size(F.array_distinct(lines)).alias("own")),
            lambda ln: F.struct(
                n.cast("long").alias("n_words"),
                chars.cast("long").alias("word_chars"),
                symbols.cast("long").alias("n_symbols"),
                (ln["all"] - ln["own"]).cast("long").alias("n_dup_lines"),
                repeat_words(ws).alias("n_repeat_words"),
                per(chars).alias("mean_word_chars"),
                per(symbols).alias("symbol_ratio"),
                per(shouts).alias("shout_ratio"),
                per(stops).alias("stop_ratio"),
                ((ln["all"] - ln["own"]) / F.greatest(ln["all"], F.lit(1))).alias("dup_line_ratio"),
            ),
        )

    return let(text, of_words)


def compile_rules(metrics: Column, rules=RULES) -> Column:
    """One boolean for the whole table: true if every bound holds."""
    verdict = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            verdict &= metrics[name] >= least
        if most is not None:
            verdict &= metrics[name] <= most
    return verdict


def base_failed(metrics: Column) -> Column:
    return (metrics["n_words"] < 20) | (100 * metrics["n_repeat_words"] > 30 * metrics["n_words"])


def verdict(text: Column, rules=RULES) -> Column:
    """Whether a text is kept, as one expression that measures it once: a filter on the columns of
    ``apply_rules`` would be pushed below them and measure it once for each bound."""
    return let(measure(text), lambda m: ~base_failed(m) & compile_rules(m, rules))


METRICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "mean_word_chars", "symbol_ratio", "shout_ratio", "stop_ratio", "dup_line_ratio",
)


def apply_rules(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` with every metric, ``base_failed`` and ``kept``."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in (*METRICS, "base_failed", "kept")]
    held = "__quality"
    measured = docs.select(*own, measure(F.col(f"`{text}`")).alias(held))
    m = F.col(held)
    failed = base_failed(m)
    return measured.select(
        *own, *(m[c].alias(c) for c in METRICS), failed.alias("base_failed"), (~failed & compile_rules(m, rules)).alias("kept")
    )


def oracle(rules=RULES) -> str:
    """The query over ``documents`` in DuckDB SQL."""
    bounds = []
    for name, least, most in rules:
        bounds += [f"{name} >= {least}"] if least is not None else []
        bounds += [f"{name} <= {most}"] if most is not None else []
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i+{WINDOW - 1}], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
cov AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM w),
ln AS (SELECT r, count(*) AS n_all, count(DISTINCT x) AS n_own FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_all - n_own, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  greatest(len(ws), 1) AS per, (length(t) - length(replace(t, '!!', ''))) / 2 AS shouts,
  len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS stops, greatest(coalesce(n_all, 0), 1) AS n_lines
  FROM w LEFT JOIN cov USING (r) LEFT JOIN ln USING (r)),
q AS (SELECT *, word_chars / per AS mean_word_chars, n_symbols / per AS symbol_ratio, shouts / per AS shout_ratio, stops / per AS stop_ratio,
  n_dup_lines / n_lines AS dup_line_ratio, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(bounds)} AS kept FROM q"""
