"""Byte tokens, chat layouts and evaluation prompts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderleaf.fixed import food_rules as rules
from cinderleaf.fixed import templates as text_rules
from cinderleaf.functions.template import render
from cinderleaf.functions.text import normalize_whitespace, squeeze

OFFSET = len(rules.SPECIAL_TOKENS)
BOUNDARY_ID = rules.SPECIAL_TOKENS.index("<|endoftext|>")
VISION_ID = rules.SPECIAL_TOKENS.index("<|vision_pad|>")
AUDIO_ID = rules.SPECIAL_TOKENS.index("<|audio_pad|>")


def _ids(text: Column) -> Column:
    chars = F.filter(F.split(text, ""), lambda ch: ch != "")
    return F.transform(chars, lambda ch: F.ascii(ch) % 256 + OFFSET)


def encode_bytes(
    text: Column, bos: bool = False, eos: bool = False, max_length: int | None = None
) -> Column:
    """Token ids: code point modulo 256 after the special ids, of the normalised text."""
    ids = _ids(normalize_whitespace(text))
    edge = F.array(F.lit(BOUNDARY_ID))
    if bos:
        ids = F.concat(edge, ids)
    if eos:
        ids = F.concat(ids, edge)
    return F.slice(ids, 1, max_length) if max_length else ids


def decode_bytes(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.char(F.pmod(i - OFFSET, F.lit(256)))), "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_each(pieces: pd.Series) -> pd.Series:
    return pieces.map(lambda ps: [unicodedata.normalize("NFKC", p) for p in ps], na_action="ignore")


def multimodal_sequence(text: Column, vision_tokens: Column, audio_tokens: Column) -> Column:
    """Token ids with `<image>` and `<audio>` replaced in place by runs of pad ids."""
    tag = "(<image>|<audio>)"
    pads = F.transform(
        F.regexp_extract_all(text, F.lit(tag), F.lit(1)),
        lambda t: F.when(t == "<image>", F.array_repeat(F.lit(VISION_ID), vision_tokens)).otherwise(
            F.array_repeat(F.lit(AUDIO_ID), audio_tokens)
        ),
    )
    gaps = F.transform(_nfkc_each(F.split(text, tag, -1)), lambda g: _ids(squeeze(g)))
    woven = F.zip_with(
        gaps, pads, lambda g, p: F.concat(g, F.coalesce(p, F.array().cast("array<int>")))
    )
    return F.flatten(woven)


def chat_template(messages: Column, add_generation_prompt: bool = True) -> Column:
    """`<|role|>` blocks joined by newlines; other roles are left out."""
    known = F.filter(messages, lambda m: m["role"].isin("system", "user", "assistant", "tool"))
    parts = F.transform(
        known, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])
    )
    if add_generation_prompt:
        parts = F.concat(parts, F.array(F.lit("<|assistant|>\n")))
    return F.array_join(parts, "\n")


def history_prompt(messages: Column) -> Column:
    parts = F.transform(
        messages,
        lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), m["content"], F.lit("\n\n")),
    )
    return F.concat(F.array_join(parts, ""), F.lit("[ASSISTANT]\n"))


def _json_text(value: Column) -> Column:
    wrapped = F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def render_format(system: Column, user: Column, answer: Column, layout: str) -> Column:
    """Struct (text, tokens, percent) of one training example in a chat layout."""
    if layout == "sharegpt":
        turns = [("system", system), ("human", user), ("gpt", answer)]
        blocks = [
            F.concat(F.lit(f'  {{\n    "from": "{who}",\n    "value": '), _json_text(v), F.lit("\n  }"))
            for who, v in turns
        ]
        text = F.concat(F.lit("[\n"), F.concat_ws(",\n", *blocks), F.lit("\n]"))
    else:
        template = {"chatml": text_rules.CHATML, "alpaca": text_rules.ALPACA}[layout]
        text = render(template, {"system": system, "user": user, "assistant": answer})
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    tokens = F.ceil(units / 4)
    percent = F.least(F.lit(100), F.floor(tokens / 2048 * 100 + 0.5))
    return F.struct(
        text.alias("text"), tokens.cast("long").alias("tokens"), percent.cast("long").alias("percent")
    )


def eval_prompt(
    benchmark: str, question: Column, choices: Column | None = None
) -> Column:
    """Prompt text of one benchmark item."""
    if benchmark == "mmlu":
        options = [
            F.concat(F.lit(f"\n{letter}) "), F.get(choices, F.lit(i)))
            for i, letter in enumerate("ABCD")
        ]
        return F.concat(question, *options, F.lit("\nAnswer:"))
    if benchmark == "gsm8k":
        return F.concat(question, F.lit("\n"))
    if benchmark in ("mmmu", "air_bench"):
        tag = "<image>" if benchmark == "mmmu" else "<audio>"
        return F.concat(F.lit(f"{tag} "), question, F.lit("\nAnswer:"))
    return question
