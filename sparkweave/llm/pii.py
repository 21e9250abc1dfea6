"""Personal data: fixed patterns, and bootstrapped contextual extraction.  DataFrame functions only.

Positions come from the text between matches: a regular expression's matches and the
pieces that splitting by it leaves alternate, so running sums of their lengths are offsets.

Bootstrapping: tokens with a digit or an at-sign are *mentions*; the words around a mention
are its lexical *patterns*; there a neighbouring mention stands as a class token, `@` or `0`,
and the start of the text as `@^` (no other word has a digit or an at-sign).  Mentions inside spans of the fixed patterns are seeds.  On the
graph of (pattern, instance) counts over the whole corpus, a pattern's confidence is the
smoothed share of its mentions whose instances are trusted, and an instance's trust is the
noisy-or of its patterns' confidences; a few rounds of both spread trust from the seeds.
Mentions in the slot of a pattern with high confidence and enough distinct seeds are reported,
whatever their shape (a name without digit or at-sign is no mention).  Words of any length count.  An instance of fewer than SHORT characters is too common to vouch for its
patterns: it is reported and counts against them, but gains no trust, and as a piece of a longer
span (`555` of a telephone number) it is not an instance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._blocks import shared_checkpoint_dir

KINDS = ("email", "ip", "card", "phone", "context")
#: Possessive where no backtracking can matter, and bound to the start of a run, so that no text takes square time or deep stacks.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
MENTION = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
SPACES = r"[\x20\x09-\x0D]+"
SPAN = "array<struct<b:int,e:int,m:string,g:string,n:string>>"
_STEP = 500
SHORT = 4


def located(df: DataFrame, out: str, pattern: str, where: Column) -> DataFrame:
    """Adds every match in t as (b, e, m: the match, g: the text before it since the last match, n: after it).

    In steps, each a projection of its own: what an expression uses several times is then computed once.
    """
    df = df.withColumns({
        "_m": F.when(where, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")),
        "_p": F.when(where, F.split("t", pattern, -1)).otherwise(F.array().cast("array<string>")),
    })
    pairs = F.zip_with("_m", F.slice("_p", F.lit(1), F.size("_m")), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    pairs = F.zip_with(pairs, F.slice("_p", F.lit(2), F.size("_m")), lambda x, n: F.struct(x["m"].alias("m"), x["g"].alias("g"), n.alias("n")))
    df = df.withColumn("_x", F.when(F.size("_m") > 0, pairs).otherwise(F.array().cast("array<struct<m:string,g:string,n:string>>"))).drop("_m", "_p")
    pairs, count = F.col("_x"), F.size("_x")
    empty = F.array().cast(SPAN)

    def add(acc, x):
        b = acc["p"] + F.length(x["g"])
        e = b + F.length(x["m"])
        return F.struct(e.alias("p"), F.array_append(acc["s"], F.struct(b.alias("b"), e.alias("e"), x["m"].alias("m"), x["g"].alias("g"), x["n"].alias("n"))).cast(SPAN).alias("s"))

    def part(k):  # appending copies, so a text with many matches is taken in steps
        return F.aggregate(F.slice(pairs, k * _STEP + 1, F.lit(_STEP)), F.struct(F.lit(0).alias("p"), empty.alias("s")), add)

    def join(acc, x):
        moved = F.transform(x["s"], lambda y: F.struct((y["b"] + acc["p"]).alias("b"), (y["e"] + acc["p"]).alias("e"), y["m"].alias("m"), y["g"].alias("g"), y["n"].alias("n"))).cast(SPAN)
        return F.struct((acc["p"] + x["p"]).alias("p"), F.array_append(acc["s"], moved).cast(f"array<{SPAN}>").alias("s"))

    parts = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / _STEP).cast("int")), part)
    whole = F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("p"), F.array().cast(f"array<{SPAN}>").alias("s")), join)["s"])
    return df.withColumn(out, F.when(count > 0, whole).otherwise(empty)).drop("_x")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid_ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+", "").rlike("^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def base_spans(df: DataFrame) -> DataFrame:
    """Adds a column of (b, k: index of the kind, e) for each kind of the fixed patterns in t."""
    t = F.col("t")
    digit = t.rlike("[0-9]")
    df = located(df, "email", EMAIL, t.contains("@"))
    df = located(df, "ip", IP, digit & t.contains("."))
    df = located(df, "card", CARD, digit)
    df = located(df, "phone", PHONE, t.contains("+"))
    fits = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: _valid_ip(x["m"]),
        "card": lambda x: F.length(_digits(x["m"])).between(12, 19) & luhn(_digits(x["m"])),
        "phone": lambda x: F.length(_digits(x["m"])).between(9, 15),
    }

    def marked(k):
        return F.transform(F.filter(k, fits[k]), lambda x: F.struct(x["b"].alias("b"), F.lit(KINDS.index(k)).alias("k"), x["e"].alias("e")))

    return df.withColumns({k: marked(k) for k in KINDS[:4]})


def mentions(df: DataFrame) -> DataFrame:
    """Adds (b, e, i: instance, seed, patterns) of each token of t with a digit or an at-sign; base has the seeds."""
    df = located(df, "found", MENTION, F.col("t").rlike("[0-9@]"))
    lead, tail = r"^[^0-9A-Za-z+]+", r"[^0-9A-Za-z]+$"
    token = lambda x: F.when(x["m"].contains("@"), "@").otherwise("0")
    at = lambda k: F.get("found", k)
    nothing = F.lit("")

    def core(x, k):
        cut = F.length(x["m"]) - F.length(F.regexp_replace(x["m"], lead, ""))
        inner = F.regexp_replace(F.regexp_replace(x["m"], lead, ""), tail, "")
        # Two words to the left reach over two mentions at most.
        before = F.when(k > 0, F.concat(F.when(k > 1, token(at(k - 2))).otherwise("@^"), F.lit(" "), at(k - 1)["g"], F.lit(" "), token(at(k - 1)), F.lit(" "))).otherwise("@^ ")
        after = F.when(k + 1 < F.size("found"), F.concat(F.lit(" "), token(at(k + 1)))).otherwise(nothing)
        one_space = lambda t: F.regexp_replace(t, SPACES, " ")
        left = F.lower(F.substring_index(F.rtrim(one_space(F.concat(before, x["g"]))), " ", -2))
        right = F.lower(F.substring_index(F.ltrim(one_space(F.concat(x["n"], after))), " ", 1))
        return F.struct((x["b"] + cut).alias("b"), (x["b"] + cut + F.length(inner)).alias("e"), inner.alias("i"), left.alias("left"), right.alias("right"))

    df = df.withColumn("found", F.filter(F.transform("found", core), lambda x: x["i"] != ""))

    def shaped(x):
        near = F.element_at(F.split(x["left"], " "), -1)
        shapes = F.array(F.concat(x["left"], F.lit(" _")), F.concat(near, F.lit(" _ "), x["right"]), F.when(near.rlike("[:=#]$"), F.concat(near, F.lit(" _"))))
        seed = F.exists("base", lambda s: (s["b"] < x["e"]) & (s["e"] > x["b"]))
        return F.struct(x["b"].alias("b"), x["e"].alias("e"), x["i"].alias("i"), seed.alias("seed"), F.array_distinct(F.array_compact(shapes)).alias("patterns"))

    shaped_all = F.transform("found", shaped)
    return df.withColumn("mentions", F.filter(shaped_all, lambda x: ~x["seed"] | (F.length(x["i"]) >= SHORT))).drop("found")


def score_patterns(edges: DataFrame, rounds: int = 3, smoothing: float = 1.0) -> DataFrame:
    """edges(pattern, instance, n, seed) -> (pattern, confidence, seeds): rounds of trust over the graph."""
    trust = edges.groupBy("instance").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(0.0)).alias("trust"), F.max("seed").alias("fixed"))
    for step in range(rounds):
        patterns = edges.drop("seed").join(trust, "instance").groupBy("pattern").agg(
            (F.sum(F.col("n") * F.col("trust")) / (F.sum("n") + smoothing)).alias("confidence"),
            F.sum(F.when(F.col("fixed"), 1).otherwise(0)).alias("seeds"),
        )
        if step + 1 < rounds:
            spread = edges.drop("seed").filter(F.length("instance") >= SHORT).join(patterns.filter("seeds > 0"), "pattern").groupBy("instance").agg(
                (1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("said")
            )
            trust = trust.select("instance", "fixed").join(spread, "instance", "left").select("instance", "fixed", F.when(F.col("fixed"), 1.0).otherwise(F.coalesce("said", F.lit(0.0))).alias("trust"))
            trust = trust.checkpoint()
    return patterns


def find_personal_data(docs: DataFrame, confidence: float = 0.6, min_seeds: int = 3, rounds: int = 3) -> DataFrame:
    """Spans of personal data in each whole text, in code points, end exclusive.

    Returns one row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of
    the base spans), spans (base and contextual ones, `kind:start:end` by start, then kind),
    n_context.  Null text is empty; null doc_id stays null; repeated rows are one document to
    the pattern graph and each get a row; other columns are ignored.
    """
    shared_checkpoint_dir(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    held = base_spans(slim).withColumn("base", F.array_sort(F.concat(*KINDS[:4])))
    held = mentions(held).select("doc_id", F.xxhash64("t").alias("h"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]], "base", "mentions").checkpoint()

    told = held.filter(F.size("mentions") > 0).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", F.explode("mentions").alias("x")).select(
        "doc_id", "h", "x.b", "x.e", F.col("x.i").alias("instance"), "x.seed", F.explode("x.patterns").alias("pattern")
    )
    edges = told.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")).checkpoint()
    good = score_patterns(edges, rounds).filter((F.col("confidence") >= confidence) & (F.col("seeds") >= min_seeds)).select("pattern")
    new = told.filter(~F.col("seed")).join(good, "pattern", "left_semi")
    new = new.groupBy("doc_id", "h").agg(F.collect_set(F.struct("b", F.lit(4).alias("k"), "e")).alias("added"))
    out = held.join(new.withColumnRenamed("doc_id", "d").withColumnRenamed("h", "hh"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh")), "left")
    names = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["b"], s["e"])), ",")
    added = F.coalesce(F.col("added"), F.array().cast("array<struct<b:int,k:int,e:int>>"))
    return out.select(
        "doc_id", *[f"n_{k}" for k in KINDS[:4]], F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.array_sort(F.concat(F.col("base").cast("array<struct<b:int,k:int,e:int>>"), added))).alias("spans"), F.size(added).cast("long").alias("n_context"),
    )
