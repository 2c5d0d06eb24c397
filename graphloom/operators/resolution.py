"""Names of one article mapped to canonical ones.

Every target that has candidates is put to the verifier, all in parallel; which of the answers
count is decided afterwards, by a fold over the article's names in their order. The fold is sequential
by meaning (an answer is ignored once its target was matched by an earlier one), so an
article's names are gathered in one row; articles never interact.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.json_repair import parsed
from graphloom.functions.text import strip


def decisions(answers: DataFrame) -> DataFrame:
    """``(doc_id, target, ok, canonical, matches)`` from ``(doc_id, target, response)``.

    ``ok`` is false for an answer without the two fields, or whose canonical name is no string.
    """
    rows = answers.select("doc_id", "target", F.try_parse_json(parsed(F.col("response"), "dict")).alias("v"))
    name, matches = "try_variant_get(v, '$.canonical_name', 'variant')", "try_variant_get(v, '$.matches', 'array<variant>')"
    is_text = F.coalesce(F.schema_of_variant(F.expr(name)) == "STRING", F.lit(False))
    ok = is_text & F.expr(matches).isNotNull()
    texts = F.expr(f"transform({matches}, m -> try_variant_get(m, '$', 'string'))")
    canonical = strip(F.expr("try_variant_get(v, '$.canonical_name', 'string')"))
    return rows.select("doc_id", "target", ok.alias("ok"), F.when(ok, canonical).alias("canonical"), F.when(ok, F.filter(texts, lambda m: m.isNotNull())).alias("matches"))


def fold_entities(order: list[str], answers: dict[str, tuple[bool, str, list[str]]]) -> dict[str, str]:
    """The mapping of one article's entities; ``order`` are its names, ``answers`` those of targets with candidates.

    A group is a target with its matches in the article. It takes the canonical name that its first
    mapped member already has, else the verifier's, and all members take it, also those mapped
    elsewhere before. Fewer than two names have no mapping at all.
    """
    if len(order) < 2:
        return {}
    known, canon, done = set(order), {}, set()
    for target in order:
        if target in done:
            continue
        ok, proposed, matches = answers.get(target, (False, "", []))
        if not ok:
            canon.setdefault(target, target)
            continue
        group = [target, *(m for m in matches if m in known)]
        earlier = next((canon[m] for m in group if m in canon), "")
        canon.update(dict.fromkeys(group, earlier or proposed))
        done.update(matches)
    return {name: canon.get(name, name) for name in dict.fromkeys([*order, *canon])}


def fold_relations(order: list[str], answers: dict[str, tuple[bool, str, list[str]]]) -> tuple[dict[str, str], list[str]]:
    """The mapping of one article's relations, and the singletons still to be shortened.

    Differs from entities: a target without candidates or with a failed answer becomes a singleton, and
    every target that was asked is done.
    """
    if len(order) < 2:
        return {}, []
    known, canon, done, single = set(order), {}, set(), []
    for target in order:
        if target in done:
            continue
        if target not in answers:
            single.append(target)
            continue
        ok, proposed, matches = answers[target]
        done.add(target)
        if not ok:
            single.append(target)
            continue
        group = [target, *(m for m in matches if m in known)]
        earlier = next((canon[m] for m in group if m in canon), "")
        canon.update(dict.fromkeys(group, earlier or proposed))
        done.update(matches)
    return canon, single


_ANSWER = "struct<target:string,ok:boolean,canonical:string,matches:array<string>>"


def _gathered(ordered: DataFrame, decided: DataFrame, name: str) -> DataFrame:
    names = ordered.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col(name).alias("name")))).alias("n"))
    asked = decided.groupBy("doc_id").agg(F.collect_list(F.struct("target", "ok", "canonical", "matches")).alias("answers"))
    rows = names.join(asked, "doc_id", "left")
    return rows.select("doc_id", F.col("n.name").alias("names"), F.coalesce("answers", F.array().cast(f"array<{_ANSWER}>")).alias("answers"))


def _answers(rows) -> dict[str, tuple[bool, str, list[str]]]:
    return {r["target"]: (bool(r["ok"]), r["canonical"] or "", [] if r["matches"] is None else list(r["matches"])) for r in rows}


def entity_map(ordered: DataFrame, decided: DataFrame) -> DataFrame:
    """``(doc_id, variant, canonical)`` from ``entity_order`` and ``decisions``."""

    @F.pandas_udf("array<struct<variant:string,canonical:string>>")
    def fold(names: pd.Series, answers: pd.Series) -> pd.Series:
        return pd.Series([[{"variant": k, "canonical": v} for k, v in fold_entities(list(n), _answers(a)).items()] for n, a in zip(names, answers)])

    rows = _gathered(ordered, decided, "name").select("doc_id", F.explode(fold("names", "answers")).alias("m"))
    return rows.select("doc_id", "m.variant", "m.canonical")


def relation_groups(ordered: DataFrame, decided: DataFrame) -> DataFrame:
    """``(doc_id, variant, canonical, ord)`` from ``relation_order`` and ``decisions``.

    ``ord`` is set for singletons only, whose canonical name is still open (null).
    """

    @F.pandas_udf("array<struct<variant:string,canonical:string,ord:int>>")
    def fold(names: pd.Series, answers: pd.Series) -> pd.Series:
        out = []
        for n, a in zip(names, answers):
            canon, single = fold_relations(list(n), _answers(a))
            # a singleton mapped before is asked about too, and its short form replaces the mapping
            rows = [{"variant": k, "canonical": v, "ord": None} for k, v in canon.items()]
            out.append(rows + [{"variant": k, "canonical": None, "ord": i} for i, k in enumerate(single)])
        return pd.Series(out)

    rows = _gathered(ordered, decided, "relation").select("doc_id", F.explode(fold("names", "answers")).alias("m"))
    return rows.select("doc_id", "m.variant", "m.canonical", "m.ord")


def relation_map(ordered: DataFrame, groups: DataFrame, shortened: DataFrame) -> DataFrame:
    """``(doc_id, variant, canonical)``; ``shortened`` is ``(doc_id, relation, short)``.

    A singleton takes its short form, or keeps its name where there is none; what is still
    unmapped keeps its name. An article with fewer than two relations has no mapping.
    """
    single = groups.filter("ord is not null").select("doc_id", "variant").join(shortened.select("doc_id", F.col("relation").alias("variant"), "short"), ["doc_id", "variant"], "left")
    single = single.select("doc_id", "variant", F.coalesce("short", "variant").alias("last"))
    mapped = groups.filter("ord is null").select("doc_id", "variant", "canonical")
    sizes = ordered.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    rows = ordered.select("doc_id", F.col("relation").alias("variant")).join(sizes, "doc_id", "left_semi")
    rows = rows.join(mapped, ["doc_id", "variant"], "left").join(single, ["doc_id", "variant"], "left")
    return rows.select("doc_id", "variant", F.coalesce("last", "canonical", "variant").alias("canonical"))


def apply_map(triples: DataFrame, mapping: DataFrame, *fields: str) -> DataFrame:
    """Replaces the named fields by their canonical names; what is not in the mapping stays. Further columns are dropped."""
    triples = triples.select("doc_id", "pos", "subject", "relation", "object")
    for c in fields:
        keyed = mapping.select("doc_id", F.col("variant").alias(c), F.col("canonical").alias("__new"))
        triples = triples.join(keyed, ["doc_id", c], "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
    return triples.select("doc_id", "pos", "subject", "relation", "object")


def merge_stats(mapping: DataFrame) -> DataFrame:
    """``(doc_id, n_names, n_merged)``: how many names were mapped to another one."""
    merged = F.count_if(F.col("variant") != F.col("canonical"))
    return mapping.groupBy("doc_id").agg(F.count("*").alias("n_names"), merged.alias("n_merged"))
