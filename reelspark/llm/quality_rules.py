"""Quality rules over documents as a bitmask ledger, in DataFrame functions alone.

Every rule is evaluated once: the ledger holds each document's measurements and one failure bit
for each rule. Once it is written (save_ledger), a policy, a versioned set of rules applied as a mask to
the stored bits, or an ablation reads the ledger and never a text.

Defined results: a null or empty text has no words and zero measurements (and so fails the rule on
few words); repeated rows and rows without id stay, each with its own row; an empty table gives none;
further columns, whatever their names, stay or don't matter. A very long text is measured in its row,
with its words and the hashes of its windows in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import id_and_text, word_array

WINDOW = 3
SYMBOLS = "#*$%&|<>"

#: Rule and the test that a document failing it meets, over the measurements; the position is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("shouting", "5 * n_upper > 3 * word_chars"),
]
#: Versions of the policy: the rules that reject a document.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "many_symbols", "repeated_lines", "word_length", "shouting"],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"]


def mask_of(policy: str | list[str]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bit = {name: 1 << k for k, (name, _) in enumerate(RULES)}
    return sum(bit[name] for name in set(names))


def _left_after(text: Column, removed: str) -> Column:
    return F.length(text) - F.length(F.translate(text, removed, ""))


def _windows(words: Column) -> Column:
    """64-bit hashes of the windows of three words."""
    return F.transform(F.slice(words, F.lit(1), F.size(words) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES of every row."""
    return _measures(id_and_text(docs), ["doc_id"])


def _measures(d: DataFrame, beside: list[str]) -> DataFrame:
    text = F.col("text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    d = d.select(
        *beside,
        word_array(text).alias("words"),
        lines.alias("lines"),
        _left_after(text, SYMBOLS).alias("n_symbols"),
        _left_after(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).alias("word_chars"),
    )
    n = F.size("words")
    d = d.select(
        *beside,
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_upper",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(n > WINDOW, _windows(F.col("words"))).otherwise(F.expr("cast(array() as array<bigint>)")).alias("windows"),
    )
    # Only where the distinct hashes are fewer than the windows are these sorted with their positions.
    # Equal neighbours then name the repeated windows, and two starts that lie k words apart cover
    # min(k, 3) words from the first on.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("ordered", F.when(repeats, ordered))
    before = lambda x, k: F.coalesce(F.get("ordered", k - 1)["h"] == x["h"], F.lit(False))
    after = lambda x, k: F.coalesce(F.get("ordered", k + 1)["h"] == x["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("ordered", lambda x, k: before(x, k) | after(x, k)), lambda x: x["i"]))
    d = d.withColumn("starts", starts)
    gaps = F.transform("starts", lambda p, k: F.least(F.coalesce(F.get("starts", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)))
    # Through a generator, as a later filter would else be pushed below and repeat what it reads of the measurements.
    made = F.struct(*(F.col(m).cast("long").alias(m) for m in MEASURES))
    return d.select(*beside, F.explode(F.array(made)).alias("_m")).select(*beside, "_m.*")


def failure_bits() -> Column:
    bits = [F.when(F.expr(test), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, test) in enumerate(RULES)]
    return sum(bits[1:], bits[0]).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES and failed (the failure bits of all rules) of every row."""
    return measured(docs).withColumn("failed", failure_bits())


def save_ledger(docs: DataFrame, path: str) -> DataFrame:
    """Writes the ledger of docs and gives it as it was written."""
    ledger(docs).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def apply_policy(led: DataFrame, policy: str | list[str]) -> Column:
    """True where the ledger's row passes the policy."""
    return led["failed"].bitwiseAND(F.lit(mask_of(policy))) == 0


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: documents it alone rejects, rejects at all, and that all reject."""
    mask = mask_of(policy)
    counts = led.select(led["failed"].bitwiseAND(F.lit(mask)).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (name, _) in enumerate(RULES) if mask >> k & 1]
    each = counts.select("bits", "n", F.explode(F.array(*rules)).alias("r"))
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).cast("long")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        total(F.col("bits") == F.col("r.bit")).alias("rejects_alone"),
        total(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("rejects"),
        total(F.col("bits") != 0).alias("policy_rejects"),
    )


def quality_verdicts(docs: DataFrame, policy: str = "v1") -> DataFrame:
    led = ledger(docs)
    base = ~apply_policy(led, "base")
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & apply_policy(led, policy)).alias("kept"), "failed")


def drop_rejected(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """docs without the rows that the policy rejects; the row is judged where it lies, without a join."""
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    led = _measures(whole, ["_row"]).select("_row", failure_bits().alias("failed"))
    kept = led.where(apply_policy(led, policy))
    return kept.select("_row.*")
