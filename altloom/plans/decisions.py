"""The decided element table many queries start from, and its check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altloom import views
from altloom.functions import rules
from altloom.functions.base import is_blank
from altloom.operators import classify, reuse
from altloom.plans import sql as q
from altloom.session import materialize


def decided(spark, sf_dir, mode: str = "preserve", strategy: str = "smart") -> DataFrame:
    """Elements with the text of equal content and the decision on each."""
    e = views.elements(spark, sf_dir).withColumn("model_called", F.col("uid") % 2 == 0)
    cache = e.select("content_key", *reuse.OWNER, "final_alt")
    cached = reuse.with_cache(e, cache, "content_key", "final_alt")
    return classify.decide(cached, mode, strategy)


def decided_narrow(spark, sf_dir) -> DataFrame:
    """The decision on each element with marks in place of texts.

    Policy and blank tests are worked out where the texts are scanned, so that
    no text is shuffled; a text column holds ``x`` where there is a text.
    """

    def filled(name: str):
        return F.when(~is_blank(name), "x").otherwise("").alias(name)

    e = views.elements(spark, sf_dir).select(
        "uid", "shape_id", "deck", "slide_idx", "shape_idx", "shape_type", "height", "content_key", (F.col("uid") % 2 == 0).alias("model_called"),
        filled("existing_alt"), filled("generated_alt"), filled("final_alt"),
        classify.include_policy("shape_type", "width", "height", "slide_text").alias("policy"),
    )
    cache = e.select("content_key", *reuse.OWNER, "final_alt")
    return classify.decide(reuse.with_cache(e, cache, "content_key", "final_alt"))


def decided_texts(spark, sf_dir) -> DataFrame:
    """The decision on each element and the one text that follows from it.

    Decisions are made on marks. A row's own text is chosen where it is scanned
    and meets its decision by the element's key; cached texts are fetched for
    the rows that take one. No exchange carries more than one text.
    """
    d = materialize(decided_narrow(spark, sf_dir).drop("decided_alt", "cached_alt", "existing_alt", "generated_alt", "final_alt", "policy"))
    e = views.elements(spark, sf_dir)
    own = e.select(*reuse.OWNER, F.when(~is_blank("existing_alt"), F.col("existing_alt")).otherwise(F.col("final_alt")).alias("own_text"))
    asked = d.filter("decision_reason = 'cached'").select("content_key", *reuse.OWNER)
    taken = reuse.with_cache(asked, e.select("content_key", *reuse.OWNER, "final_alt"), "content_key", "final_alt").drop("content_key")
    reason = F.col("decision_reason")
    text = F.when(reason.isin("preserve_existing", "already_generated"), F.col("own_text")).when(reason == "cached", F.col("cached_alt")).otherwise("")
    return d.join(own, reuse.OWNER).join(taken, reuse.OWNER, "left").withColumn("decided_alt", text)


ENTRY_DECORATIVE = f"""(shape_type IN ('LINE', 'CONNECTOR') OR width * height < 100
   OR {q.contains_any('lower(slide_text)', rules.DECORATIVE_CONTEXT)})"""

CACHED_SQL = f"""{views.ELEMENTS_SQL},
cached AS (SELECT e.*, uid % 2 = 0 AS model_called, (SELECT arg_max(o.final_alt, (o.deck, o.slide_idx, o.shape_id)) FROM elements o
   WHERE o.content_key = e.content_key AND o.uid <> e.uid AND trim(o.final_alt) <> '') AS cached_alt FROM elements e)"""

DECIDED_SQL = f"""{CACHED_SQL},
policed AS (SELECT *, {ENTRY_DECORATIVE} AS deco,
   shape_type = 'PICTURE' OR (NOT {ENTRY_DECORATIVE} AND width * height >= 3888) AS included FROM cached),
decided AS (SELECT *, CASE WHEN trim(existing_alt) <> '' THEN 'preserve_existing' WHEN NOT included THEN 'policy_excluded'
   WHEN cached_alt IS NOT NULL THEN 'cached' WHEN model_called AND trim(final_alt) <> '' THEN 'already_generated' ELSE 'needs_generation' END AS decision_reason FROM policed)"""
