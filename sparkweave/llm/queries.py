"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import decontaminate, gam, lines, lm_score, mixing, near_dup, pii, quality, secret_scan, spelling, substrings, suffixes, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_levels() -> dict[str, Column]:
    """Domain, language and source of documents; the domain is the source's number modulo 4."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    return {"domain": F.when(number != "", F.concat(F.lit("d"), number.cast("long") % 4)), "lang": F.col("lang"), "source": F.col("source")}


#: (node, weight); a node is the path from the root.  Others weigh 1.
MIX_WEIGHTS = [
    (["d0"], 1), (["d1"], 3), (["d2"], 2), (["d3"], 2),
    *[([d, lang], w) for d in ("d0", "d1", "d2", "d3") for lang, w in (("en", 4), ("de", 3), ("fr", 2), ("es", 6))],
]


def mix_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIX_WEIGHTS, "node array<string>, weight long")


def op1_hierarchical_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"), source_levels(), mix_weights(spark), share=0.6, max_epochs=2)


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(_table(spark, sf_dir, "documents"), length=400)


def op5_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_table(spark, sf_dir, "documents"), min_chars=10)


def op3_cgk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), max_edits=0.2)


def op4_risk_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_prob_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), similarity=0.8, words=5)


def op7_assignment_lexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op8_bootstrapped_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents"))


def op10_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_windows(_table(spark, sf_dir, "documents"), window=50)


def op11_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"), components=32)


def op12_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op13_bloom_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), min_chars=5, min_count=3, ratio=2, drop_every=97)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hierarchical_budget, op2_suffix_array, op3_cgk_windows, op4_risk_thresholds, op5_bloom_lines, op6_prob_min_hash, op7_assignment_lexing, op8_bootstrapped_contexts, op9_context_mixing, op10_difference_cover, op11_polarised_whitening, op12_additive_model, op13_bloom_neighbours)}


def _op1_sql(share: int = 600, epochs: int = 2, seed: int = 7) -> str:
    weights = ", ".join(f"({n[0]!r}, {(n[1] if len(n) > 1 else '')!r}, {w})" for n, w in MIX_WEIGHTS)

    def level(k: int) -> str:
        cols = ["d", "l", "s"][:k]
        names, up = ", ".join(cols), cols[:-1]
        weight = "1" if k == 3 else "coalesce(w.weight, 1)"
        join = "" if k == 3 else f"left join w on w.d = x.d and w.l = {'x.l' if k == 2 else chr(39) * 2}"
        part = f"partition by {', '.join(up)}" if up else ""
        budget = "p.budget" if up else "(select sum(n) * {} // 1000 from leaf)".format(share)
        parent = f"join b{k - 1} p using ({', '.join(up)})" if up else ""
        return f"""
        c{k} as (select {", ".join("x." + c for c in cols)}, {weight} as weight, x.cap from (select {names}, sum(n) * {epochs} as cap from leaf group by {names}) x {join}),
        o{k} as (select {names}, weight, cap, {budget} as budget,
            coalesce(sum(cap) over (win rows between unbounded preceding and 1 preceding), 0) as taken,
            sum(weight) over (win rows between current row and unbounded following) as opened
            from c{k} {parent} window win as ({part} order by cap / weight, {cols[-1]})),
        f{k} as (select *, cap::hugeint * opened::hugeint <= (budget - taken)::hugeint * weight::hugeint as is_full from o{k}),
        u{k} as (select *, sum(case when is_full then cap else 0 end) over ({part}) as used,
            sum(case when is_full then 0 else weight end) over ({part}) as lft from f{k}),
        b{k} as (select {names}, case when is_full then cap else ((budget - used)::hugeint * weight::hugeint) // lft::hugeint end as budget from u{k})"""

    return f"""
    with w(d, l, weight) as (values {weights}),
    docs as (select doc_id, coalesce(case when regexp_extract(source, '([0-9]+)$', 1) <> '' then 'd' || (regexp_extract(source, '([0-9]+)$', 1)::bigint % 4) end, '(none)') as d,
        coalesce(lang, '(none)') as l, coalesce(source, '(none)') as s,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n_tokens from documents),
    leaf as (select d, l, s, sum(n_tokens) as n from docs group by d, l, s),
    {level(1)}, {level(2)}, {level(3)},
    plan as (select d, l, s, budget // n as epochs, budget % n as rest from b3 join leaf using (d, l, s) where budget > 0 and n > 0),
    ranked as (select doc_id, d, l, s, n_tokens, epochs, rest,
        sum(n_tokens) over (partition by d, l, s order by md5('{seed}:' || epochs::bigint || ':' || doc_id), doc_id) - n_tokens as taken
        from docs join plan using (d, l, s))
    select doc_id, d || '/' || l || '/' || s as leaf, n_tokens::bigint as n_tokens, epochs::bigint as whole_epochs,
        greatest(0, least(n_tokens, rest - taken))::bigint as part_tokens
    from ranked where n_tokens > 0 and (epochs > 0 or rest > taken)
    """


def oracle_sql() -> dict[str, str]:
    return {"op1_hierarchical_budget": _op1_sql()}
