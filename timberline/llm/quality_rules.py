"""Quality rules with host verdicts, in built-in functions only.

Each document is tried by four rules: too few words, too many words in repeated windows, too many symbols, too many repeated
lines. Failures are summed per host and rule. Per rule a beta prior is fitted to the rates of all hosts by moments (the spread
that chance alone explains taken off), each host's rate is shrunk towards its mean, and a host is rejected when a shrunk rate
lies more than ``deviations`` standard deviations of the prior above that mean. So the limit follows from the hosts themselves: where
all are alike none is rejected, however often a rule fails, and a host of few documents has to fail far more often.

A null text has no words and fails; a null host is a host of its own (the null one). Repeated rows count each. The documents
are measured once; of each row only the counts are written and read again, so very long texts and a host of a third of all rows
cost no more than their share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.session import broadcast_if_small, materialise

WINDOW = 8
# Rules over the measured counts. The first two fail a document by themselves, all four count for its host.
RULES = {
    "short": "n_words < 20",
    "repeated": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
# Rates are whole ten-thousandths, so that their sums over hosts are exact whatever their order.
SCALE = 10_000


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def repeat_words(ws: Column) -> Column:
    """Words within windows that occur twice or more: equal hashes are neighbours once sorted."""
    def covered(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)
        starts = F.array_sort(F.filter(
            F.transform(sorted_windows, lambda w, k: F.when(
                ((k > 0) & (F.get(sorted_windows, k - 1)["h"] == w["h"])) | ((k < n - 1) & (F.get(sorted_windows, k + 1)["h"] == w["h"])),
                w["i"])),
            lambda i: i.isNotNull()))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(starts, zero, lambda a, i: F.struct(
            (i + WINDOW).alias("end"), (a["total"] + i + WINDOW - F.greatest(i, a["end"])).alias("total")), lambda a: a["total"])

    def from_windows(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered))

    def windows(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(found) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(found, i, WINDOW)))

    return let(ws, lambda found: F.when(F.size(found) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows(found), from_windows)))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, host and the counts of each whole text; one narrow stage."""
    text = F.coalesce("text", F.lit(""))
    word = r"[^\x20\x09-\x0D]+"
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(word))
    return docs.select("doc_id", F.col("source").alias("host"), text.alias("text")).select(
        "doc_id", "host",
        F.regexp_count("text", F.lit(word)).cast("long").alias("n_words"),
        F.char_length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda found: F.struct(F.size(found).cast("long").alias("n"), F.size(F.array_distinct(found)).alias("distinct"))).alias("lines"),
        repeat_words(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("n_repeat_words"),
    ).select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", F.col("lines.n").alias("n_lines"),
        (F.col("lines.n") - F.col("lines.distinct")).alias("n_dup_lines"), "n_repeat_words",
    ).withColumn("base_failed", F.expr(f"{RULES['short']} OR {RULES['repeated']}"))


def host_counts(measured: DataFrame) -> DataFrame:
    """Documents of each host, and how many fail each rule."""
    return measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(rule).cast("long")).alias(name) for name, rule in RULES.items()])


def priors(hosts: DataFrame) -> DataFrame:
    """One row: mean ``m``, strength ``s`` (in documents) and ``limit`` of the beta prior of each rule."""
    scaled = lambda name: F.floor(SCALE * F.col(name) / F.col("n"))
    # Chance alone spreads the rate of a host of n documents by m (1 - m) / n; the sum of 1 / n is kept in whole parts too.
    sums = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum(F.floor(F.lit(1_000_000) / F.col("n"))).alias("parts"), *[
        out for name in RULES for out in (F.sum(scaled(name)).alias(f"{name}_1"), F.sum(scaled(name) * scaled(name)).alias(f"{name}_2"))])
    found = sums.where("hosts > 0")
    for name in RULES:
        found = found.withColumn(f"{name}_mean", F.col(f"{name}_1") / F.col("hosts") / SCALE)
        found = found.withColumn(f"{name}_m", F.greatest(F.least(f"{name}_mean", F.lit(0.999)), F.lit(0.001)))
        spread = F.col(f"{name}_2") / F.col("hosts") / (SCALE * SCALE) - F.col(f"{name}_mean") * F.col(f"{name}_mean")
        chance = F.col(f"{name}_m") * (1 - F.col(f"{name}_m")) * F.col("parts") / F.col("hosts") / 1_000_000
        found = found.withColumn(f"{name}_v", F.greatest(spread - chance, F.lit(1e-9)))
        # The strength stays within 1 and 1000 documents.
        found = found.withColumn(f"{name}_s", F.greatest(F.lit(1.0), F.least(
            F.lit(1000.0), F.col(f"{name}_m") * (1 - F.col(f"{name}_m")) / F.col(f"{name}_v") - 1)))
    return found.select(*[f"{name}_{x}" for name in RULES for x in "ms"])


def host_verdicts(measured: DataFrame, deviations: float = 3.0) -> DataFrame:
    """Shrunk rate of each rule and verdict of each host."""
    hosts = host_counts(measured)
    # The priors are a single row.
    joined = hosts.join(F.broadcast(priors(hosts)))
    m, s = (lambda name: F.col(f"{name}_m")), (lambda name: F.col(f"{name}_s"))
    rates = {name: (F.col(name) + m(name) * s(name)) / (F.col("n") + s(name)) for name in RULES}
    # The difference to the mean is squared, as a square root may differ in its last digit between systems.
    beyond = [(rates[name] > m(name)) & ((rates[name] - m(name)) * (rates[name] - m(name)) * (s(name) + 1)
              > deviations * deviations * m(name) * (1 - m(name))) for name in RULES]
    rejected = beyond[0]
    for one in beyond[1:]:
        rejected = rejected | one
    return joined.select("host", *[rates[name].alias(f"{name}_rate") for name in RULES], rejected.alias("host_rejected"))


def apply(docs: DataFrame, deviations: float = 3.0, max_hosts: int = 100_000) -> DataFrame:
    measured = materialise(measure(docs), "quality-measured")
    hosts = broadcast_if_small(materialise(host_verdicts(measured, deviations), "quality-hosts"), max_hosts).withColumnRenamed("host", "of_host")
    return measured.join(hosts, F.col("host").eqNullSafe(F.col("of_host")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), *[f"{name}_rate" for name in RULES], "host_rejected")
