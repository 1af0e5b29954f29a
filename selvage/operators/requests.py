"""Requests and notes brought into one form, and references to blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of editorial notes (the last is the default), actions, presets, and the longest request.
EDITORIAL_KINDS = ("answer", "reconstruction", "clarification")
ACTIONS = ("extract", "build", "variant")
PRESETS = ("brief", "cheatsheet", "study", "custom")
LONGEST_REQUEST = 4000


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def _given(c: Column) -> Column:
    return F.nullif(_bare(c), F.lit(""))


def _anchor(c: Column) -> Column:
    return _bare(F.regexp_replace(_bare(c), r"^\[\[|\]\]$", ""))


def _note(rows: DataFrame, section: str, json: str) -> tuple[DataFrame, dict]:
    rows = rows.withColumn("__v", F.try_parse_json(json))
    field = lambda k: _bare(F.try_variant_get("__v", f"$.{k}", "string"))
    names = ("block", "as_written", "corrected", "reason", "topic", "resolution", "kind", "refers_to", "text")
    out = {k: field(k) for k in names}
    return rows, out | {"section": F.coalesce(F.nullif(field("section"), F.lit("")), F.col(section)), "anchor": _anchor(field("anchor"))}


def corrections(rows: DataFrame, key: str, section: str = "section", json: str = "json") -> DataFrame:
    """A4: corrections of (key, section, json) rows; missing fields are empty, the section is the row's own."""
    rows, f = _note(rows, section, json)
    return rows.select(key, *(f[k].alias(k) for k in ("section", "anchor", "block", "as_written", "corrected", "reason")))


def conflicts(rows: DataFrame, key: str, section: str = "section", json: str = "json") -> DataFrame:
    """A4: conflicts; a variant is an object or a text without an anchor, empty ones go; no resolution is null."""
    rows, f = _note(rows, section, json)
    of = lambda v, k: F.try_variant_get(v, f"$.{k}", "string")
    some = F.coalesce(F.try_variant_get("__v", "$.variants", "array<variant>"), F.array().cast("array<variant>"))
    is_object = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    plain = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
    kept = F.filter(some, lambda v: is_object(v) | ~plain(v).isin("", "0", "false"))
    one = lambda v: F.struct(
        F.when(is_object(v), _anchor(of(v, "anchor"))).otherwise("").alias("anchor"), F.when(is_object(v), _bare(of(v, "text"))).otherwise(_bare(plain(v))).alias("text")
    )
    return rows.select(key, f["section"].alias("section"), f["topic"].alias("topic"), F.transform(kept, one).alias("variants"), F.nullif(f["resolution"], F.lit("")).alias("resolution"), f["reason"].alias("reason"))


def editorial_notes(rows: DataFrame, key: str, section: str = "section", json: str = "json") -> DataFrame:
    """A4: editorial notes; an unknown kind is a clarification."""
    rows, f = _note(rows, section, json)
    kind = F.when(f["kind"].isin(*EDITORIAL_KINDS), f["kind"]).otherwise(EDITORIAL_KINDS[-1])
    return rows.select(key, f["section"].alias("section"), kind.alias("kind"), f["refers_to"].alias("refers_to"), f["text"].alias("text"))


def queue_params(action: Column, params: Column, stages: Sequence[str], backends: Sequence[str]) -> Column:
    """struct(problem, backend, from_stage, review, force, use_vision, preset, prompt, template) of a queue item.

    ``params`` is JSON.  Fields that the action does not take are null, and all are where there is a problem.
    """
    v = F.try_parse_json(F.coalesce(params, F.lit("{}")))
    text = lambda k: F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    flag = lambda k: F.try_variant_get(v, f"$.{k}", "boolean")
    build, extract, variant = (action == a for a in ("build", "extract", "variant"))
    known = F.coalesce(action.isin(*ACTIONS), F.lit(False))
    bad_backend = text("backend").isNotNull() & ~text("backend").isin(*backends)
    bad_stage = build & text("from_stage").isNotNull() & ~text("from_stage").isin(*stages)
    problem = F.when(~known, "action").when(bad_backend, "backend").when(bad_stage, "stage")
    taken = {
        "backend": text("backend"), "from_stage": F.when(build, text("from_stage")), "review": F.when(build, flag("review")), "force": F.when(flag("force"), True),
        "use_vision": F.when(extract, flag("use_vision")), **{k: F.when(variant, text(k)) for k in ("preset", "prompt", "template")},
    }
    return F.struct(problem.alias("problem"), *(F.when(problem.isNull(), c).alias(k) for k, c in taken.items()))


def variant_request(preset: Column, prompt: Column, template: Column) -> Column:
    """struct(preset, prompt, template, problem) of a request; ``template:name`` names both at once.

    Without a preset, a prompt makes it custom and else a template re-typesets.
    """
    asked, q = F.lower(_bare(preset)), _given(prompt)
    named = F.startswith(asked, F.lit("template:"))
    t = F.coalesce(_given(template), F.when(named, _given(F.substring(asked, len("template:") + 1, 1 << 20))))
    p = F.when(named, "template").when(asked != "", asked).when(q.isNotNull(), "custom").when(t.isNotNull(), "template").otherwise("")
    problem = (
        F.when(p == "", "no preset").when(~p.isin(*PRESETS, "template"), "unknown preset").when((p == "custom") & q.isNull(), "no prompt")
        .when((p == "custom") & (F.length(q) > LONGEST_REQUEST), "long prompt").when((p != "custom") & q.isNotNull(), "unused prompt").when((p == "template") & t.isNull(), "no template")
    )
    return F.struct(p.alias("preset"), q.alias("prompt"), t.alias("template"), problem.alias("problem"))


BLOCK_REF = r"\[\[[A-Z][A-Za-z0-9]*[:.]b[0-9]{1,5}\]\]"


def repaired_refs(texts: DataFrame, blocks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``[[P1:b7]]`` and ``[[P1.b007]]`` become the anchor of block P1.b007; unknown ones stay; ends are trimmed.

    ``blocks``: (id, anchor), the smallest anchor of an id counts.  Only texts with references are
    joined, on their distinct references; null texts stay null, null and repeated keys are kept.
    """
    number = lambda r: F.regexp_extract(r, r"b([0-9]+)\]\]$", 1).cast("int").cast("string")
    block = lambda r: F.concat(F.regexp_extract(r, r"^\[\[([A-Za-z0-9]+)", 1), F.lit(".b"), F.when(F.length(number(r)) < 3, F.lpad(number(r), 3, "0")).otherwise(number(r)))
    refs = texts.select(F.col(key).alias("__k"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(BLOCK_REF), 0))).alias("ref")).distinct()
    known = blocks.groupBy("id").agg(F.min("anchor").alias("anchor"))
    found = refs.withColumn("id", block(F.col("ref"))).join(known, "id").groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("ref", "anchor"))).alias("__m"))
    gaps, marks = F.split(text, BLOCK_REF), F.regexp_extract_all(F.col(text), F.lit(BLOCK_REF), 0)
    mark = lambda r: F.coalesce(F.concat(F.lit("[["), F.element_at("__m", r), F.lit("]]")), r, F.lit(""))
    mended = F.array_join(F.zip_with(gaps, marks, lambda g, r: F.concat(g, mark(r))), "")
    joined = texts.join(found, F.col(key).eqNullSafe(F.col("__k")), "left")
    return joined.withColumn(text, F.when(F.col(text).isNotNull(), _bare(mended))).select(*texts.columns)
