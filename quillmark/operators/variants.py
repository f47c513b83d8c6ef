"""Variant tables: rewrite requests / responses (C3, C4), unpivot (B8), known-variant
filter (B9), promotion (B10) and deterministic rule rewriters standing in for the
external rewriting service (the service itself is outside the engine)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sentences, words

# The rewrite prompts of the text domain, in their order.
TEXT_PROMPTS = [
    "Revise this with your best effort",
    "Help me polish this",
    "Rewrite this for me",
    "Make this fluent while doing minimal change",
    "Refine this for me please",
    "Concise this for me and keep all the information",
    "Improve this in GPT way",
]

# The rewrite prompts of the code domain, in their order.
CODE_PROMPTS = [
    "Revise the code with your best effort",
    "Help me polish this code",
    "Rewrite the code with GPT style",
    "Refine the code for me please",
    "Concise the code without change the functionality",
]

# Fixed value: the instruction suffix defined for code prompts.
CODE_SUFFIX = "\nNo need to explain. Just write code without any explanation!: "

RULES = [
    "drop_every_5th",
    "first_half",
    "lower_strip",
    "reverse_sentences",
    "dedupe_adjacent",
    "swap_pairs",
    "long_words",
]


def prompts_df(spark: SparkSession, domain: str = "text") -> DataFrame:
    """Small fixed table ``(domain, variant_pos, prompt)``."""
    lst = TEXT_PROMPTS if domain == "text" else CODE_PROMPTS
    return spark.createDataFrame(
        [(domain, i, p) for i, p in enumerate(lst)],
        "domain string, variant_pos int, prompt string")


def rule_rewrite(rule: str, text, w: Column | None = None) -> Column:
    """One deterministic rewrite of ``text`` (a Column); ``w`` may carry the text's
    words already split."""
    t = F.col(text) if isinstance(text, str) else text
    w = words(t) if w is None else w
    n = F.size(w)
    if rule == "drop_every_5th":
        out = F.filter(w, lambda x, i: (i + 1) % 5 != 0)
    elif rule == "first_half":
        out = F.slice(w, 1, F.ceil(n / 2).cast("int"))
    elif rule == "lower_strip":
        return F.regexp_replace(F.lower(t), r"[.,;:!?\"()]", "")
    elif rule == "reverse_sentences":
        out = F.reverse(sentences(t))
    elif rule == "dedupe_adjacent":
        # a word equal to the word before it is dropped; the words are bound once as a
        # lambda variable, as those of an expression would be split again for every word
        out = F.get(F.transform(F.array(w), lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))), 0)
    elif rule == "swap_pairs":
        # neighbours (1,2), (3,4), ... swap; a last odd word stays
        return F.regexp_replace(F.array_join(w, " "), r"([^ ]+) ([^ ]+)", "$2 $1")
    elif rule == "long_words":
        out = F.filter(w, lambda x: F.length(x) >= 4)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return F.array_join(out, " ")


def rule_variants(df: DataFrame, rules: list[str] | None = None, text: str = "text") -> DataFrame:
    """Adds ``variants ARRAY<STRUCT<variant_pos INT, text STRING>>`` built row-locally:
    no join, no shuffle."""
    rules = rules or RULES
    # split once (or before, as ``_w``); the projection is kept because several rules reference it
    x = df if "_w" in df.columns else df.withColumn("_w", words(text))
    arr = F.array(*[
        F.struct(F.lit(i).alias("variant_pos"), rule_rewrite(r, text, F.col("_w")).alias("text"))
        for i, r in enumerate(rules)])
    return x.withColumn("variants", arr).drop("_w")


def unpacked(variants="variants") -> Column:
    """``variant_pos, text`` of every variant, one row each.  For a plain column Spark infers
    a filter on its size, which it takes down to the scan with all rewrites written out;
    it infers none for an expression."""
    return F.inline(F.transform(variants, lambda v: v))


def rule_variants_long(df: DataFrame, rules: list[str] | None = None,
                       key: str = "doc_id", text: str = "text") -> DataFrame:
    """Long form ``(doc_id, variant_pos, variant, text)`` of the rule rewrites."""
    rules = rules or RULES
    w = rule_variants(df.select(key, text), rules, text)
    return (w.select(key, unpacked())
            .withColumn("variant", F.element_at(F.array(*[F.lit(p) for p in TEXT_PROMPTS[:len(rules)]]),
                                                F.col("variant_pos") + 1))
            .select(key, "variant_pos", "variant", "text"))


def rewrite_requests(df: DataFrame, prompts: list[str] | None = None, suffix: str = "",
                     key: str = "doc_id", text: str = "text") -> DataFrame:
    """One request per (record, prompt): ``prompt: "text"``.  The prompt list is a
    handful of constants, so it is an array literal exploded per record: no join and
    no shuffle of the corpus."""
    prompts = prompts or TEXT_PROMPTS
    arr = F.array(*[F.lit(p) for p in prompts])
    x = df.select(key, text, F.posexplode(arr).alias("variant_pos", "prompt"))
    return x.select(key, F.col("variant_pos").cast("int").alias("variant_pos"),
                    F.format_string('%s%s: "%s"', F.col("prompt"), F.lit(suffix), F.col(text))
                    .alias("request"))


def attach_rewrites(df: DataFrame, responses: DataFrame, key: str = "doc_id") -> DataFrame:
    """C4: wide view — every record with its returned rewrites as an ordered array.
    ``responses`` is long ``(doc_id, variant_pos, text)``.  Responses are first reduced
    to one per (record, prompt) (a repeated response to the same prompt replaces the
    earlier one in the reference; here the choice is deterministic: the greatest text),
    so the per-record list is bounded by the prompt count even for a record with a
    huge number of responses; the reduction is map-side combined."""
    one = (responses.filter(F.col("text").isNotNull())
           .groupBy(key, "variant_pos").agg(F.max("text").alias("text")))
    per_doc = (one.groupBy(key)
               .agg(F.array_sort(F.collect_list(F.struct("variant_pos", "text"))).alias("variants")))
    return (df.join(per_doc, key, "left")
            .withColumn("variants", F.coalesce("variants", F.array().cast(
                "array<struct<variant_pos:int,text:string>>"))))


def unpivot_variants(df: DataFrame, meta: list[str], key: str = "doc_id") -> DataFrame:
    """Every non-metadata string column becomes a variant row; nulls skipped."""
    cols = [c for c in df.columns if c not in set(meta)]
    return (df.unpivot([key], cols, "variant", "text")
            .filter(F.col("text").isNotNull()))


def known_variants(variants: DataFrame, prompts: DataFrame) -> DataFrame:
    """Keep rewrites whose key is one of the prompts (left-semi, broadcast side is
    the fixed prompt list) and attach its position."""
    p = F.broadcast(prompts.select(F.col("prompt").alias("variant"), "variant_pos"))
    return variants.join(p, "variant", "inner")


def promote_variant(df: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """Use a variant / perturbed column as the new text."""
    return df.select(key, F.col(name).alias("text"), "source")


def conversation_pairs(conv: DataFrame) -> DataFrame:
    """User turn -> the next assistant turn of the same conversation, keyed by the struct
    ``doc_id`` = (conv_id, turn).  The pair is found with an equi-join on
    (conv_id, turn + 1): no window over a whole conversation, so a very long
    conversation does not land in one task."""
    u = conv.filter(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("u_turn"), F.col("text").alias("user_text"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("u_turn"), F.col("text").alias("reply"))
    return (u.join(a, ["conv_id", "u_turn"], "inner")
            .select(F.struct("conv_id", F.col("u_turn").alias("turn")).alias("doc_id"),
                    "conv_id", "u_turn", "user_text", "reply"))
