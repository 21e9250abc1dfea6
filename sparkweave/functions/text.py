"""Text functions as Columns: language, hashes, cleaning, keywords, token counts, JSON repair."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

CJK = r"[\x{4e00}-\x{9fff}]"

#: Words without content for keyword search (fixed values).
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might can shall "
    "to of in for on with at by from as into through during before after and but or not no if then else than "
    "that this these those it its he she we they them their my your our his her all each every any some most "
    "的 了 在 是 我 你 他 她 它 们 这 那 和 与 或 也 都 就 而 及 把 被 让 给 从 到 对 向 以 于"
).split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def main_language(text) -> Column:
    """'zh' where at least half of the CJK and ASCII letters are CJK, else 'en' (also without letters)."""
    zh, en = F.regexp_count(_c(text), F.lit(CJK)), F.regexp_count(_c(text), F.lit("[A-Za-z]"))
    return F.when((zh > 0) & (zh >= en), "zh").otherwise("en")


def has_chinese(text) -> Column:
    return _c(text).rlike(CJK)


def content_hash(text, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.md5(_c(text)))


def document_hash(kind, content, image, body) -> Column:
    """An id by type: text by its trimmed content, images and others by path or body."""
    what = F.when(_c(kind) == "image", _c(image)).when(_c(kind).isin("table", "equation"), _c(body)).otherwise(F.trim(_c(content)))
    return F.concat(F.lit("doc-"), F.md5(F.coalesce(what, F.lit(""))))


def args_hash(*cols) -> Column:
    return F.md5(F.to_json(F.array(*[_c(c).cast("string") for c in cols])))


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def clean(text) -> Column:
    """Trimmed, without the common HTML escapes and control characters."""
    out = F.regexp_replace(_c(text), r"^\s+|\s+$", "")
    for a, b in _ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"[\x00-\x1f\x7f-\x9f]", "")
    return F.when(_c(text).rlike(r"[&\x00-\x1f\x7f-\x9f]|^\s|\s$"), out).otherwise(_c(text))  # most texts have nothing to clean


@F.pandas_udf(StringType())
def clean_all_entities(text: pd.Series) -> pd.Series:
    """clean() with the full table of HTML entities."""
    control = re.compile(r"[\x00-\x1f\x7f-\x9f]")
    return text.map(lambda t: None if t is None else control.sub("", html.unescape(t.strip())))


def split_by_markers(text, markers: list[str]) -> Column:
    """Pieces between any of the markers, trimmed, blanks dropped."""
    if not markers:
        return F.array(_c(text))
    parts = F.split(_c(text), "|".join(re.escape(m) for m in markers), -1)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def is_number(text) -> Column:
    return _c(text).rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def as_conversation(turns) -> Column:
    """Alternating user and assistant messages."""
    return F.transform(_c(turns), lambda x, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), x.alias("content")))


def complexity(text) -> Column:
    """0 to 1: mean sentence length over 200, or twice the share of special characters."""
    t = _c(text)
    sentences = F.regexp_count(t, F.lit(r"\.")) + 1
    mean = (F.length(t) - sentences + 1) / sentences
    special = F.regexp_count(t, F.lit(r"[()\[\]{}<>$%^&*+=|\\/~`]")) / F.length(t)
    return F.when(t == "", 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.least(F.lit(1.0), mean / 200.0), special * 2)))


def chunk_size_for(length, score, base: int = 1024) -> Column:
    """Characters per chunk by document length and complexity, within 256 and 4096."""
    n, s = _c(length), _c(score)
    size = F.when(n > 100000, 2048).when(n > 50000, 1536).when(n < 10000, 512).otherwise(base)
    size = F.when(s > 0.8, F.floor(size * F.lit(0.8))).when(s < 0.3, F.floor(size * F.lit(1.2))).otherwise(size)
    return F.greatest(F.lit(256), F.least(size, F.lit(4096))).cast("int")


def keywords(text) -> Column:
    """Latin words (two letters at least, no stopwords), CJK characters and CJK pairs."""
    t = _c(text)
    words = F.filter(F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 1)
    runs = F.regexp_extract_all(t, F.lit(CJK + "+"), F.lit(0))
    singles = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(1)))))
    long_runs = F.filter(runs, lambda r: F.length(r) > 1)
    pairs = F.flatten(F.transform(long_runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    found = F.array_union(words, F.array_union(singles, pairs))
    return F.array_sort(F.array_except(found, F.array(*[F.lit(w) for w in STOPWORDS if re.fullmatch("[a-z]+", w)])))


def token_estimate(text) -> Column:
    """Tokens without a tokenizer: CJK characters, runs of letters or digits in fours, other marks."""
    t = _c(text)
    words = F.regexp_extract_all(t, F.lit("[A-Za-z0-9]+"), F.lit(0))
    pieces = F.aggregate(words, F.lit(0), lambda acc, w: acc + F.ceil(F.length(w) / 4).cast("int"))
    return (F.regexp_count(t, F.lit(CJK)) + pieces + F.regexp_count(t, F.lit(r"[^A-Za-z0-9\s\x{4e00}-\x{9fff}]"))).cast("long")


def token_counter(encode):
    """A column function that counts tokens by a tokenizer: encode(text) -> ids, such as a vocabulary's own."""

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        return text.map(lambda t: len(encode(t)) if t else 0)

    return lambda text: count(_c(text))


def token_ids(encode):
    """A column function of the ids themselves, for token_windows()."""

    @F.pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        return text.map(lambda t: list(encode(t)) if t else [])

    return lambda text: ids(_c(text))


def token_windows(ids, size: int, overlap: int) -> Column:
    """Windows of `size` ids that overlap; the last may be short."""
    step = size - overlap
    n = F.size(_c(ids))
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    return F.when(n > 0, F.transform(starts, lambda i: F.slice(_c(ids), i + 1, F.lit(size)))).otherwise(F.array().cast("array<array<int>>"))


def id_list(value, separator: str = "<SEP>") -> Column:
    """Ids of a joined string, trimmed, blanks dropped; null gives an empty list."""
    parts = F.split(F.coalesce(_c(value), F.lit("")), re.escape(separator), -1)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


# Model responses


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def without_fences(text) -> Column:
    """Without Markdown code fences around the whole answer or its parts."""
    out = F.regexp_replace(_c(text), r"(?m)^\s*```[A-Za-z0-9_+-]*[ \t]*$\n?", "")
    return _stripped(F.regexp_replace(out, "```", ""))


def without_chatter(text) -> Column:
    """Without openings such as 'Sure, here is' and 'Answer:' labels of an assistant."""
    out = F.regexp_replace(_c(text), r"(?i)^\s*(sure|certainly|of course|okay|ok)[,!.]\s*(here (is|are)[^\n:]*:)?\s*", "")
    out = F.regexp_replace(out, r"(?i)^\s*here (is|are)[^\n:]{0,80}:\s*", "")
    return _stripped(F.regexp_replace(out, r"(?i)\n+\s*(let me know if|i hope this helps|feel free to)[^\n]*$", ""))


def without_thoughts(text) -> Column:
    """Without <think> blocks; the original where nothing else is left."""
    out = _stripped(F.regexp_replace(_c(text), r"(?s)<think>.*?</think>", ""))
    return F.when(out == "", _c(text)).otherwise(out)


def repaired_json(text) -> Column:
    """JSON text with usual slips mended: fences, curly quotes, trailing commas, bare literals of other languages."""
    out = without_fences(text)
    out = F.translate(out, "“”‘’", "\"\"''")
    out = F.regexp_replace(out, r",\s*([}\]])", "$1")
    out = F.regexp_replace(out, r"(?<=[:\[,]\s{0,5})None\b", "null")
    out = F.regexp_replace(out, r"(?<=[:\[,]\s{0,5})True\b", "true")
    return F.regexp_replace(out, r"(?<=[:\[,]\s{0,5})False\b", "false")


def json_in(text) -> Column:
    """The JSON of a response: a fenced block, else from the first to the last brace or bracket."""
    t = _c(text)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(t, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(fenced != "", F.trim(fenced)).when(braces != "", braces).otherwise(t)


def parsed_json(text) -> Column:
    """A VARIANT, parsed as it is or else after repair; null if neither works."""
    found = json_in(text)
    return F.coalesce(F.try_parse_json(found), F.try_parse_json(repaired_json(found)))


def between(text, start: str, end: str) -> Column:
    """What stands between two markers, '' if they are missing."""
    return F.trim(F.regexp_extract(_c(text), f"(?s){re.escape(start)}(.*?){re.escape(end)}", 1))


def repaired_extraction(text) -> Column:
    """Extraction records with a bare | for the field delimiter, or unclosed parentheses, mended."""
    out = F.regexp_replace(without_fences(text), r'"\s*\|\s*"', '"<|>"')
    out = F.regexp_replace(out, r'\(\s*"?(entity|relationship)"?\s*<\|>', '("$1"<|>')
    out = F.regexp_replace(out, r'"\s*##', '")##')
    return F.when(F.trim(out) == "", _c(text)).otherwise(out)


def repaired_qa(text) -> Column:
    """Question and answer marks brought to `Question:` and `Answer:` at the start of a line."""
    out = F.regexp_replace(without_fences(text), r"(?im)^[\s*#>-]*(?:question|q|问题)\s*\d*\s*(?:\*\*)?\s*[:：]\s*(?:\*\*)?", "Question: ")
    out = F.regexp_replace(out, r"(?im)^[\s*#>-]*(?:answer|a|答案|回答)\s*\d*\s*(?:\*\*)?\s*[:：]\s*(?:\*\*)?", "Answer: ")
    return F.when(F.trim(out) == "", _c(text)).otherwise(out)


def repaired(text, kind: str = "general", markers: list[str] | None = None) -> Column:
    """A response mended for what it should hold; the response itself where nothing would be left, '' for null.

    kind: general (fences and thoughts go), kg_extraction (records), qa_pair (labels), text_markers (each of
    markers, however its brackets and blanks were written, on a line of its own).
    """
    plain = without_thoughts(without_fences(text))
    out = {"general": lambda: plain, "kg_extraction": lambda: repaired_extraction(plain), "qa_pair": lambda: repaired_qa(plain), "text_markers": lambda: plain}[kind]()
    if kind == "text_markers":
        for m in markers or []:
            loose = r"\s*".join(re.escape(w) for w in re.findall(r"\w+", m))
            out = F.regexp_replace(out, rf"(?im)^[\s*#]*[\[【(（]\s*{loose}\s*[\]】)）]\s*[:：]?[*\s]*?$", F.lit(m.replace("$", r"\$")))
    return F.when(F.coalesce(_stripped(out), F.lit("")) != "", out).otherwise(F.coalesce(_c(text), F.lit("")))


# Token probabilities


def top_candidates(logprobs) -> Column:
    """array<struct<token,logprob>> as array<struct<text,prob>>."""
    return F.transform(_c(logprobs), lambda x: F.struct(x["token"].alias("text"), F.exp(x["logprob"]).alias("prob")))


def joint_probability(probs) -> Column:
    """Geometric mean of the positive probabilities."""
    p = F.filter(_c(probs), lambda x: x > 0)
    return F.exp(F.aggregate(p, F.lit(0.0), lambda acc, x: acc + F.log(x)) / F.size(p))


def min_probability(probs) -> Column:
    return F.array_min(F.filter(_c(probs), lambda x: x > 0))


def mean_probability(probs) -> Column:
    p = F.filter(_c(probs), lambda x: x > 0)
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x) / F.size(p)


def mean_confidence(tokens) -> Column:
    """Mean of prob over the sum of the five best candidates; tokens array<struct<prob, candidates array<struct<prob>>>>."""
    t = F.filter(_c(tokens), lambda x: x["prob"] > 0)
    return F.aggregate(t, F.lit(0.0), lambda acc, x: acc + x["prob"] / F.aggregate(F.slice(x["candidates"], 1, 5), F.lit(0.0), lambda s, y: s + y["prob"])) / F.size(t)
