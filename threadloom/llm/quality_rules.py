"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one
bit per failed rule; a policy is a named, versioned mask over those bits, so policies
are applied, compared and ablated later by bitwise arithmetic without reading a text
again. Only built-in expressions are used.

Defined cases: a null text counts as empty and fails ``few_words``; an empty table gives
an empty ledger; repeated rows get a ledger row each; extra columns stay, and a column
that has the name of a ledger column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, carried, let, unpacked, words_of

#: Bit number, name, and the condition under which a document fails, over the measurements.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "few_words", "n_words < 50"),
    (1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "10 * n_symbols > n_words"),
    (3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    (4, "short_words", "word_chars < 2 * n_words"),
    (5, "long_words", "word_chars > 12 * n_words"),
    (6, "shouting", "2 * n_upper > n_letters"),
    (7, "few_letters", "2 * n_letters < word_chars"),
)
BIT = {name: bit for bit, name, _ in RULES}
#: Policy versions: the rules that reject. A version is never edited; a new one is added.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(name for _, name, _ in RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")


def mask_of(policy: str) -> int:
    """The bits that a policy version looks at."""
    return sum(1 << BIT[name] for name in POLICIES[policy])


def _repeat_words(words: Column) -> Column:
    """Words inside a three-word window that occurs twice or more in the array.

    Windows are sorted by a 64-bit fingerprint together with their start, so equal ones
    are neighbours; the union of the flagged intervals is then measured in one fold.
    """

    def covered(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )

        def flagged(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            starts = F.sort_array(F.transform(again, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            return F.aggregate(
                starts,
                start,
                lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n")),
                lambda a: a["n"],
            )

        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(F.sort_array(windows), flagged))

    return let(words, covered)


def _measured(df: DataFrame, text: str) -> DataFrame:
    """The rows of ``df``, carried, with the measurements and ``fail_bits``."""
    held = carried(df, whole=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    whole = F.col("whole")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    measured = held.withColumns(
        {
            "words": let(words_of(whole), lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"))),
            "lines": let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))),
            "word_chars": F.length(F.regexp_replace(whole, f"[{WS}]+", "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, "[#*$%&|<>]+", ""))).cast("long"),
            "n_letters": (F.length(whole) - F.length(F.regexp_replace(whole, r"\p{L}+", ""))).cast("long"),
            "n_upper": (F.length(whole) - F.length(F.regexp_replace(whole, r"\p{Lu}+", ""))).cast("long"),
        }
    )
    flat = measured.withColumns(
        {
            "n_words": F.col("words.n_words").cast("long"),
            "n_repeat_words": F.col("words.n_repeat_words").cast("long"),
            "n_lines": F.col("lines.n").cast("long"),
            "n_dup_lines": (F.col("lines.n") - F.col("lines.d")).cast("long"),
        }
    )
    bits = sum((F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, _, rule in RULES), F.lit(0))
    return flat.withColumn("fail_bits", bits.cast("long"))


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measurements and ``fail_bits``, one bit for each rule that the text fails."""
    return unpacked(_measured(df, text), df.columns, {c: F.col(c) for c in (*MEASURES, "fail_bits")})


def passes(policy: str = "v1", bits: str = "fail_bits") -> Column:
    """True where a ledger row fails no rule of the policy."""
    return F.col(bits).bitwiseAND(F.lit(mask_of(policy))) == 0


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """What each rule of a policy does: documents failing it, and documents that only it rejects.

    The ledger is first counted by bit pattern, so at most ``2 ** len(RULES)`` rows are
    looked at per rule whatever the size of the corpus. An empty ledger gives zeros.
    """
    mask = mask_of(policy)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << BIT[name]).alias("bit")) for name in POLICIES[policy]])
    spark = rows.sparkSession
    every = spark.range(1).select(F.inline(rules))
    hits = patterns.select("bits", "n", F.inline(rules))
    counted = hits.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"),
    )
    return every.select("rule").join(counted, "rule", "left").select(
        "rule", F.coalesce("failing", F.lit(0)).alias("failing"), F.coalesce("only_this", F.lit(0)).alias("only_this")
    )


def keep(df: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows of ``df`` that pass the policy, with the columns that ``df`` has."""
    return unpacked(_measured(df, text).where(passes(policy)), df.columns)
