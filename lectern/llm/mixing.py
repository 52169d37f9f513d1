"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / quality, u a hash of its id; the smallest keys of a
source come first. A source's budget is its share of all tokens, bounded by its
tokens times its repeats: complete epochs precede the fraction, which takes keys
in order until the budget is spent. Prefix sums run over buckets of the key and
then within one bucket. Buckets are ``PER_OCTAVE`` steps of the key's logarithm:
dividing by a quality only shifts them, so whatever the qualities none holds more
than about 1 / (e * PER_OCTAVE / ln 2), or 0.1 %, of a source.

Whether a source can reach its share is told by the draws: it can't if all of its
documents are used as often as they may be and the share is not reached yet.

Defined cases: sources without documents are reported and cannot reach their
share; documents without a target, or with a null source, are left out; null
and empty texts have no tokens and are not drawn; equal keys go by the id; a
source listed twice keeps its summed weight and largest number of repeats; a missing
weight or number of repeats is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialize

PER_OCTAVE = 256


def quality(text) -> F.Column:
    """Weight of a document: the share of letters, marks and blanks in it, at least 0.05."""
    clean = F.char_length(F.regexp_replace(text, r"[^\p{L}\p{M}\s]+", ""))
    return F.greatest(F.lit(0.05), clean / F.greatest(F.char_length(text), F.lit(1)))


class Mixture:
    def __init__(self, docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", seed: int = 11):
        self.id_col = id_col
        self.targets = targets.groupBy("source").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats")).where("source is not null")
        u = (F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(seed)), 11) + 1) / F.lit(float(1 << 53))
        keyed = (
            docs.select(F.col(id_col).cast("long").alias("id"), "source", "text").where("id is not null").join(self.targets.select("source"), "source", "left_semi")
            .select("id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_tokens"), F.greatest(F.lit(1e-300), -F.log(u) / quality(F.coalesce("text", F.lit("")))).alias("key"))
            .withColumn("bucket", F.floor(F.log2("key") * PER_OCTAVE).cast("int"))
        )
        # one pass over the texts; everything after it works on a few bytes a row
        self.keyed = materialize(keyed, "mix-keys")
        self.buckets = self.keyed.where("n_tokens > 0").groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
        have = self.buckets.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"))
        plan = self.targets.join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long")).withColumn("documents", F.coalesce("documents", F.lit(0)))
        every = Window.partitionBy(F.lit(0))  # as many rows as there are sources
        plan = plan.withColumn("all_tokens", F.sum("tokens").over(every)).withColumn("all_weight", F.sum("weight").over(every))
        share = F.coalesce(F.try_divide(F.col("weight") * F.col("all_tokens"), F.col("all_weight")), F.lit(0.0))
        most = F.col("tokens") * F.col("max_repeats")
        self.plan = (
            plan.withColumn("target_tokens", share)
            .withColumn("budget", F.least(share, most.cast("double")))
            .withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int"))
            .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
        )

    def draws(self) -> DataFrame:
        """(id, source, n_tokens, uses) of every document that is used."""
        before = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        starts = self.buckets.withColumn("before", F.coalesce(before, F.lit(0))).select("source", "bucket", "before")
        run = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0))
        keyed = self.keyed.where("n_tokens > 0").withColumn("run", run).join(starts, ["source", "bucket"])
        used = keyed.join(self.plan.select("source", "epochs", "rest"), "source")
        uses = F.col("epochs") + F.when(F.col("before") + F.col("run") <= F.col("rest"), 1).otherwise(0)
        return used.select(F.col("id").alias(self.id_col), "source", "n_tokens", uses.cast("int").alias("uses")).where("uses > 0")

    def outcome(self) -> DataFrame:
        """The plan with what was drawn of each source, and whether its share can be reached."""
        got = self.draws().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("actual_tokens"), F.max("uses").alias("most_uses"), F.min("uses").alias("least_uses"), F.count("*").alias("used"))
        out = self.plan.join(got, "source", "left").fillna(0, ["actual_tokens", "most_uses", "least_uses", "used"])
        spent = (F.col("used") == F.col("documents")) & (F.col("least_uses") == F.col("max_repeats")) | (F.col("max_repeats") <= 0) | (F.col("documents") == 0)
        short = F.col("actual_tokens") * F.col("all_weight") < F.col("weight") * F.col("all_tokens")
        return out.withColumn("reachable", ~(spent & short))

    def report(self) -> DataFrame:
        """Per source of the targets: wanted and actual tokens and shares, and whether its share can be reached."""
        total = F.sum("actual_tokens").over(Window.partitionBy(F.lit(0)))
        return self.outcome().select(
            "source",
            "tokens",
            F.try_divide(F.col("weight"), F.col("all_weight")).alias("target_share"),
            "target_tokens",
            "actual_tokens",
            F.try_divide(F.col("actual_tokens"), total).alias("actual_share"),
            "most_uses",
            "reachable",
        )
