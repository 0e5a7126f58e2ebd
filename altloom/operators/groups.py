"""Group trees: flattening, roll-up, verdicts and suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altloom.functions import rules
from altloom.functions.base import is_blank
from altloom.functions.gates import is_empty_placeholder
from altloom.operators.classify import element_type, first_rule
from altloom.operators.joins import group_children
from altloom.session import materialize

SLIDE = ["deck", "slide_idx"]


def placed(elements: DataFrame) -> DataFrame:
    """Elements with ``shape_idx``, their place in reading order, which tells those with one id apart.

    A scan of packages gives it as ``z_order``, its ``shape_idx`` counts within
    a group only. Where there is no order, rows are numbered by id and parent.
    """
    if "z_order" in elements.columns:
        return elements.withColumn("shape_idx", F.col("z_order"))
    if "shape_idx" in elements.columns:
        return elements
    order = Window.partitionBy(*SLIDE).orderBy("shape_id", F.col("parent_id").asc_nulls_first())
    return elements.withColumn("shape_idx", F.row_number().over(order) - 1)


def parents(elements: DataFrame) -> DataFrame:
    """Of every element the place of its parent, ``up``, and the number of elements on its slide.

    Ids may repeat on a slide: the parent is the first other element with the
    id in reading order. An id that no other element has gives none.
    """
    nodes = elements.select(*SLIDE, "shape_idx", "shape_id", "parent_id")
    turn = F.row_number().over(Window.partitionBy(*SLIDE, "shape_id").orderBy("shape_idx"))
    firsts = nodes.withColumn("turn", turn).filter("turn <= 2").groupBy(*SLIDE, "shape_id").agg(
        F.min("shape_idx").alias("__first"), F.max(F.when(F.col("turn") == 2, F.col("shape_idx"))).alias("__second")
    )
    sizes = nodes.groupBy(*SLIDE).agg(F.count(F.lit(1)).alias("n"))
    met = nodes.join(firsts.withColumnRenamed("shape_id", "parent_id"), [*SLIDE, "parent_id"], "left").join(sizes, SLIDE)
    up = F.when(F.col("__first") != F.col("shape_idx"), F.col("__first")).otherwise(F.col("__second"))
    return met.select(*SLIDE, "shape_idx", "shape_id", "parent_id", "n", up.alias("up"))


def flatten(elements: DataFrame) -> DataFrame:
    """Depth, path of ids and path of places from the top of every element.

    Pointer doubling: each round joins what an element knows of its nearest
    ``reach`` ancestors with what the last of them knows of its own, so a tree
    of depth d takes about log2 d rounds. Elements whose path has ended are
    joined no more. A path longer than its slide has elements runs in a
    circle: it is given up at once. Elements that no root reaches (a circle, a
    lost parent) come out with a null depth and themselves as their path.
    """
    state = materialize(
        parents(placed(elements)).select(
            *SLIDE, "shape_idx", "shape_id", "n", "up", F.col("parent_id").isNull().alias("rooted"),
            F.array("shape_id").alias("path"), F.array("shape_idx").alias("places"),
        )
    )
    reach = 1
    while not state.filter((F.col("up").isNotNull()) & (F.col("n") >= reach)).isEmpty():
        open_ = F.col("up").isNotNull() & (F.col("n") >= reach)
        known = state.select(*SLIDE, F.col("shape_idx").alias("up"), F.col("up").alias("__up"), F.col("rooted").alias("__rooted"),
            F.col("path").alias("__path"), F.col("places").alias("__places"))
        longer = state.filter(open_).drop("rooted").join(known, [*SLIDE, "up"]).select(
            *SLIDE, "shape_idx", "shape_id", "n", F.col("__up").alias("up"), F.col("__rooted").alias("rooted"),
            F.concat("__path", "path").alias("path"), F.concat("__places", "places").alias("places"),
        )
        state = materialize(state.filter(~open_).unionByName(longer))
        reach *= 2
    whole = F.col("rooted") & F.col("up").isNull()
    return state.select(
        *SLIDE, "shape_idx", "shape_id", F.when(whole, F.size("path") - 1).alias("depth"),
        F.when(whole, F.col("path")).otherwise(F.array("shape_id")).alias("path"),
        F.when(whole, F.col("places")).otherwise(F.array("shape_idx")).alias("places"),
    )


def ancestors(flat: DataFrame) -> DataFrame:
    """(element, ancestor, levels from the top) for every pair on a path; ancestors by place and by id."""
    above = F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("id"), F.slice("places", 1, F.size("places") - 1).alias("idx"))
    pairs = flat.filter("depth > 0").select(*SLIDE, "shape_idx", "shape_id", F.posexplode(above).alias("ancestor_depth", "above"))
    return pairs.select(*SLIDE, "shape_idx", "shape_id", "ancestor_depth", F.col("above.id").alias("ancestor_id"), F.col("above.idx").alias("ancestor_idx"))


def is_image_like(elements: DataFrame, flat: DataFrame) -> DataFrame:
    """Pictures, picture fills, and groups that hold one at any depth."""
    own = ~is_empty_placeholder("shape_type", "text") & (
        (F.col("shape_type") == "PICTURE") | (F.col("fill_kind") == "picture")
    )
    marked = placed(elements).select(*SLIDE, "shape_idx", "shape_id", own.alias("own"))
    holding = (
        ancestors(flat).join(marked.filter("own").select(*SLIDE, "shape_idx"), [*SLIDE, "shape_idx"])
        .select(*SLIDE, F.col("ancestor_idx").alias("shape_idx")).distinct().withColumn("holds", F.lit(True))
    )
    return marked.join(holding, [*SLIDE, "shape_idx"], "left").select(
        *SLIDE, "shape_idx", "shape_id", (F.col("own") | F.coalesce("holds", F.lit(False))).alias("image_like")
    )


def semantic_kind(ratio: Column, children: Column, decorative: Column) -> Column:
    """Icon a group may form, by proportion and number of children."""
    # Bounds of each icon, checked in this order.
    return first_rule(
        (ratio.between(0.8, 1.4) & (children >= 3) & (decorative >= 2), "lightbulb"),
        (ratio.between(0.9, 1.6) & (children >= 5), "brain"),
        (ratio.between(1.2, 2.0) & (children >= 2), "lungs"),
        (ratio.between(0.7, 1.5) & (children >= 2), "graduation cap"),
        (children >= 5, "complex icon"),
        (children >= 3, "composite icon"),
    )


def child_counts(elements: DataFrame) -> DataFrame:
    """Children of every group by kind; one aggregate, no level loop."""
    kind = element_type("shape_type")
    meaningful = kind.isin("image", "shape", "chart")
    wordy = ~meaningful & ~is_blank("text")
    children = group_children(elements).select(*SLIDE, "parent_id", "shape_id").join(
        elements.select(*SLIDE, "shape_id", meaningful.alias("meaningful"), wordy.alias("wordy"), kind.alias("kind")),
        [*SLIDE, "shape_id"],
    )
    return children.groupBy(*SLIDE, "parent_id").agg(
        F.count(F.lit(1)).alias("children"),
        F.count_if("meaningful").alias("meaningful"),
        F.count_if("wordy").alias("wordy"),
        F.count_if(~F.col("meaningful") & ~F.col("wordy")).alias("decorative"),
        F.min(F.when(F.col("meaningful"), F.col("kind"))).alias("first_kind"),
        F.max(F.when(F.col("meaningful"), F.col("kind"))).alias("last_kind"),
        F.min(F.when(F.col("meaningful"), F.col("shape_id"))).alias("only_child"),
    )


def group_semantic(elements: DataFrame) -> DataFrame:
    sizes = elements.select(
        *SLIDE, F.col("shape_id").alias("parent_id"),
        F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(1.0).alias("ratio"),
    )
    return child_counts(elements).join(sizes, [*SLIDE, "parent_id"]).withColumn(
        "semantic", semantic_kind(F.col("ratio"), F.col("children"), F.col("decorative"))
    )


def rollup_groups(elements: DataFrame, semantics: bool = False) -> DataFrame:
    """Text and policy of every group, and the child it makes redundant."""
    groups = group_semantic(elements)
    semantic = F.col("semantic") if semantics else F.lit(None).cast("string")
    n, total = F.col("meaningful"), F.col("children")

    def counted(count: Column, word: str) -> Column:
        return F.concat(F.lit("Group containing "), count.cast("string"), F.lit(f" {word}"), F.when(count != 1, "s").otherwise(""))

    icon = F.concat(F.lit("Group representing "), semantic, F.lit(" icon"))
    has_icon = semantic.isNotNull()
    text = first_rule(
        (has_icon & (n > 1), F.concat(icon, F.lit(" with "), n.cast("string"), F.lit(" elements"))),
        (has_icon, icon),
        ((n == 0) & (F.col("wordy") > 0), counted(F.col("wordy"), "text element")),
        ((n == 0) & (F.col("decorative") > 0), counted(total, "decorative element")),
        (n == 0, counted(total, "element")),
        (n == 1, F.concat(F.lit("Group containing "), F.col("first_kind"))),
        (F.col("first_kind") == F.col("last_kind"), F.concat(F.lit("Group of "), n.cast("string"), F.lit(" "), F.col("first_kind"), F.lit("s"))),
        (F.lit(True), F.concat(F.lit("Group containing "), n.cast("string"), F.lit(" visual elements"))),
    )
    policy = first_rule(
        ((n == 0) & has_icon, "semantic_parent_generic"),
        ((n == 0) & (F.col("wordy") > 0), "text_only_group"),
        ((n == 0) & (F.col("decorative") > 0), "decorative_group"),
        (n == 0, "generic_group"),
        ((n == 1) & has_icon, "parent_kept_child_decorative"),
        (n == 1, "child_promoted_both_keep"),
        (has_icon, "composite_semantic_container"),
        (F.lit(True), "composite_structural"),
    )
    return groups.select(
        *SLIDE, F.col("parent_id").alias("group_id"), text.alias("group_alt"), policy.alias("policy"),
        F.when((n == 1) & has_icon, F.col("only_child")).alias("mark_decorative"),
    )


def group_decorative(elements: DataFrame, decorative: Column) -> DataFrame:
    """Is a whole group decorative, by the share of decorative children?"""
    content = (F.length(F.trim("text")) > 10) | F.col("shape_type").isin("PICTURE", "CHART")
    children = group_children(elements).select(*SLIDE, "parent_id", "shape_id").join(
        elements.select(*SLIDE, "shape_id", decorative.alias("deco"), content.alias("content")), [*SLIDE, "shape_id"]
    )
    counts = children.groupBy(*SLIDE, "parent_id").agg(
        F.count(F.lit(1)).alias("children"),
        F.count_if("deco").alias("decorative_children"),
        F.count_if(~F.col("deco") & F.col("content")).alias("content_children"),
    )
    n, share = F.col("children"), F.col("decorative_children") / F.col("children")
    verdict = (
        (F.col("decorative_children") == n)
        | ((n <= 3) & (share >= 0.67))
        | ((n <= 5) & (share >= 0.8))
        | ((F.col("content_children") == 0) & (share >= 0.5))
    )
    return counts.select(*SLIDE, F.col("parent_id").alias("group_id"), "children", "decorative_children", verdict.alias("decorative"))


# --- selector ---------------------------------------------------------------------


def selector(elements: DataFrame, version: str) -> DataFrame:
    """One record per candidate; unfilled text placeholders are none."""
    open_box = (F.col("shape_type") == "PLACEHOLDER") & is_blank("text")
    return elements.filter(~open_box).select(
        F.lit(version).alias("selector_version"),
        F.concat(F.lit("slide_"), F.col("slide_idx").cast("string"), F.lit("_shape_"), F.col("shape_idx").cast("string")).alias("element_id"),
        "deck",
        F.lit(None).cast("string").alias("parent_group_id"),
        F.lit("include_atomic").alias("selector_decision"),
        F.lit("image").alias("content_scope"),
        F.lit("stub_v1").alias("reason_code"),
        F.lit("Stub v1: included for processing").alias("human_reason"),
        F.lit("none").alias("escalation_strategy"),
        F.create_map(F.lit("original_shape_type"), F.col("shape_type")).alias("metadata"),
    )


def reviewed_alt(existing: Column) -> Column:
    """Existing text that is no placeholder and long enough."""
    placeholder = existing.rlike("(?i)" + "|".join(rules.SELECTOR_PLACEHOLDERS))
    return ~is_blank(existing) & ~placeholder & (F.length(existing) >= rules.SELECTOR_SHORTEST_ALT)


def selector_decide(df: DataFrame, policy: str = "preserve") -> DataFrame:
    """Contract precedence: stop, preserve, decorative, group, atomic, redundancy.

    Needs ``decorative``, ``has_overlay``, ``annotation_hint``, ``children`` and
    ``first_copy`` next to the element columns. An overlay beats decoration.
    What fits no rule is included and flagged as ambiguous.
    """
    kind = F.col("shape_type")
    keep = reviewed_alt(F.col("existing_alt")) if policy == "preserve" else F.lit(False)
    reason = F.coalesce(
        first_rule(
            (F.col("annotation_hint").isin(rules.HARD_STOP_OVERLAYS), "escalate_system_ui_like"),
            (keep, "preserve_existing_alt"),
            (F.col("decorative") & ~F.col("has_overlay"), "decorative_rule"),
            ((kind == "GROUP") & (F.col("children") >= 2), "group_semantics"),
            (kind == "GROUP", "ambiguous_grouping"),
            (kind.isin("PICTURE", "CHART", "TABLE") & F.col("first_copy"), "atomic_visual"),
            (~F.col("first_copy"), "repeated_content"),
        ),
        F.lit("ambiguous_structure"),
    )
    r = F.col("reason_code")
    decision = (
        F.when(r == "escalate_system_ui_like", "escalate_manual_review")
        .when(r == "decorative_rule", "exclude_decorative")
        .when(r.isin("group_semantics", "ambiguous_grouping"), "include_group")
        .when(r == "repeated_content", "exclude_redundant")
        .otherwise("include_atomic")
    )
    return df.withColumn("reason_code", reason).withColumns(
        {
            "selector_decision": decision,
            "content_scope": F.when(decision == "include_group", "group").otherwise("image"),
            "escalation_strategy": F.when(r == "escalate_system_ui_like", "defer_to_manual_review")
            .when(r.startswith("ambiguous_"), "include_with_ambiguous_reason")
            .otherwise("none"),
            "human_reason": F.concat(F.lit("Rule: "), r),
        }
    )


def suppress_children(decisions: DataFrame, flat: DataFrame, policy: str = "preserve") -> DataFrame:
    """Everything under an included group becomes redundant to it.

    The topmost included group is the parent named. In preserve mode a child
    text by a human adds a conflict row. Elements are told apart by their place.
    """
    included = placed(decisions).filter("selector_decision = 'include_group'").select(*SLIDE, F.col("shape_idx").alias("ancestor_idx"))
    owner = (
        ancestors(flat).join(included, [*SLIDE, "ancestor_idx"])
        .groupBy(*SLIDE, "shape_idx").agg(F.min_by("ancestor_id", "ancestor_depth").alias("parent_group_id"))
    )
    joined = placed(decisions).join(owner, [*SLIDE, "shape_idx"], "left")
    inside = F.col("parent_group_id").isNotNull()
    columns = [*SLIDE, "shape_idx", "shape_id", "parent_group_id"]
    settled = joined.select(
        *columns,
        F.when(inside, "exclude_redundant").otherwise(F.col("selector_decision")).alias("selector_decision"),
        F.when(inside, "group_suppression").otherwise(F.col("reason_code")).alias("reason_code"),
    )
    if policy != "preserve":
        return settled
    conflicts = joined.filter(inside & F.col("human_alt")).select(
        *columns, F.lit("preserve_conflict").alias("selector_decision"), F.lit("preserve_conflict").alias("reason_code")
    )
    return settled.unionByName(conflicts)


def constraints() -> dict[str, Column]:
    """Name and condition of every way a record can be wrong."""

    def short(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    def outside(name: str, values: list[str]) -> Column:
        return ~F.coalesce(F.col(name), F.lit("")).isin(values)

    return {
        "selector_version": short("selector_version"),
        "element_id": short("element_id"),
        "parent_group_id": F.coalesce(F.col("parent_group_id") == "", F.lit(False)),
        "selector_decision": outside("selector_decision", rules.SELECTOR_DECISIONS),
        "content_scope": outside("content_scope", rules.SELECTOR_SCOPES),
        "reason_code": short("reason_code"),
        "human_reason": short("human_reason"),
        "escalation_strategy": outside("escalation_strategy", rules.SELECTOR_ESCALATIONS),
        "metadata": F.col("metadata").isNull(),
        "extra_fields": F.size(F.coalesce("extra_fields", F.array().cast("array<string>"))) > 0,
        "redundant_without_parent": (F.col("selector_decision") == "exclude_redundant") & ~F.col("has_parent_field"),
    }


def violations(records: DataFrame) -> DataFrame:
    """One row per broken constraint; no row means the batch may go on.

    ``extra_fields`` lists fields the schema does not know; ``has_parent_field``
    tells whether the record had the parent field at all.
    """
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in constraints().items()]))
    return records.select("deck", "element_id", F.explode(broken).alias("violation"))


def batch_verdict(records: DataFrame) -> DataFrame:
    """Fail-safe verdict per deck: valid only without any violation."""
    bad = sum((F.coalesce(b, F.lit(False)).cast("int") for b in constraints().values()), F.lit(0))
    return records.groupBy("deck").agg(
        F.count(F.lit(1)).alias("records"), F.sum(bad).alias("violations"), (F.sum(bad) == 0).alias("valid")
    )


def manual_review(records: DataFrame) -> DataFrame:
    return records.filter(
        (F.col("selector_decision") == "escalate_manual_review") | (F.col("escalation_strategy") == "defer_to_manual_review")
    )
