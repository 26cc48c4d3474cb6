"""Requests to the page model as columns and parameters: messages, rendered prompts and what they cost, sampling."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.functions.columns import BUCKETS, OUTPUT_CUT, TOKEN_BUDGET, seed_for

#: The chat template's marks, an image's mark, the indent before a text that comes as a plain string, bytes
#: around an image's prompt, commands, and tokens of an image by bucket and of the text around it.
PREFIX = "<|start_of_role|>system<|end_of_role|>{command}<|end_of_text|>\n<|start_of_role|>user<|end_of_role|>"
SUFFIX = "<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>"
IMAGE = "<image>\n"
INDENT = " " * 8
SCAFFOLD = 16
EXTRACT, CLASSIFY, HEADINGS = "structured_extraction", "classify_figure", "fix_headings"
IMAGE_TOKENS = {"B0": 1200, "B1": 1920, "B2": 3672, "B3": 7152}
TEXT_TOKENS = 1360
MODEL_LENGTH, MAX_TOKENS, CHARS_PER_TOKEN = 32768, 20000, 3.5
PAGE_CHARS, PAGE_TOKENS = 11_000, 3500


def template_tag(text: Column, tags: list[str]) -> Column:
    """The first of the template's task tags, in their order, that the text has as <tag>; null without any."""
    return F.coalesce(*[F.when(text.contains(f"<{t}>"), F.lit(t)) for t in tags], F.lit(None).cast("string"))


def expanded(text: Column, prompts: dict[str, str]) -> Column:
    """The text as the template leaves it: one with a task tag becomes that tag's prompt, with the image's mark before or behind
    it, as it stood to the tag."""
    tag = template_tag(text, list(prompts))
    out = text
    for name, prompt in prompts.items():
        before = F.instr(text, "<image>") < F.instr(text, f"<{name}>")
        with_image = F.when(before, F.lit(IMAGE + prompt)).otherwise(F.lit(prompt + IMAGE))
        out = F.when(tag == name, F.when(text.contains("<image>"), with_image).otherwise(F.lit(prompt))).otherwise(out)
    return out


def rendered(command: str, text: Column, prompts: dict[str, str] | None = None, as_string: bool = False) -> Column:
    """The prompt that the chat template makes of a command and a text."""
    body = expanded(text, prompts) if prompts else text
    if as_string:
        body = F.when(body == text, F.concat(F.lit(INDENT), text)).otherwise(body)
    return F.concat(F.lit(PREFIX.format(command=command)), body, F.lit(SUFFIX))


def text_prompt_tokens(command: str, text: Column, prompts: dict[str, str] | None = None) -> Column:
    """Tokens of a text prompt at most: bytes, of the longer of the two forms that a server can make of it."""
    return F.greatest(*[F.octet_length(rendered(command, text, prompts, s)) for s in (False, True)])


def image_prompt_tokens(command: str, image_tokens: Column) -> Column:
    return F.lit(SCAFFOLD + len(command.encode()) + 2) + image_tokens


def plan(prompt_tokens: Column, cap: int | None = None, budget: int = TOKEN_BUDGET) -> Column:
    """Output tokens that a prompt leaves, at most cap; null where it leaves none, which is an error of the request."""
    room = F.lit(budget) - prompt_tokens
    return F.when(room >= 1, F.least(room, F.lit(cap)) if cap else room).cast("int")


def output_cut(kind: str, bucket: str | None = None) -> int:
    """Output tokens past which a call is a runaway; for an unknown bucket the largest."""
    return OUTPUT_CUT["text"] if kind == "text" else OUTPUT_CUT.get(bucket) or max(OUTPUT_CUT[b] for b in ("B0", *(n for n, _, _ in BUCKETS)))


def context_chars(model_length: int = MODEL_LENGTH, max_tokens: int = MAX_TOKENS) -> int:
    """Characters of a text that fit beside the output."""
    return int((model_length - max_tokens) * CHARS_PER_TOKEN)


def output_budget(model_length: int = MODEL_LENGTH, max_tokens: int = MAX_TOKENS) -> dict:
    """Output tokens that each bucket's image leaves, and the buckets where max_tokens cannot be reached."""
    room = {b: model_length - n - TEXT_TOKENS for b, n in IMAGE_TOKENS.items()}
    short = {b: n for b, n in room.items() if n < max_tokens}
    return {"model_length": model_length, "max_tokens": max_tokens, "room": room, "ok": not short, "short": short}


# -- messages -----------------------------------------------------------------------------------------------------


def message_list(command: str, part: Column) -> Column:
    """The request's messages as JSON: the command as the system's, one part as the user's."""
    return F.concat(F.lit('[{"role":"system","content":' + json.dumps(command) + '},{"role":"user","content":['), part, F.lit("]}]"))


def text_messages(text: Column, command: str = EXTRACT) -> Column:
    return message_list(command, F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text"))))


def image_messages(png: Column, command: str = EXTRACT) -> Column:
    """Of a PNG's bytes."""
    url = F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(png), "\\s", ""))
    return message_list(command, F.to_json(F.struct(F.lit("image_url").alias("type"), F.struct(url.alias("url")).alias("image_url"))))


def plain_text_messages(text: Column, command: str = EXTRACT) -> Column:
    """The older form: the user's content is the text itself."""
    return F.concat(F.lit('[{"role":"system","content":' + json.dumps(command) + '},{"role":"user","content":'), F.get(F.split(F.to_json(F.struct(text.alias("t"))), '^\\{"t":'), F.lit(1)), F.lit("]"))


@F.pandas_udf(T.StringType())
def input_key(messages: pd.Series) -> pd.Series:
    """SHA-256 of a request's messages with their keys in order, which names the page's input."""
    return messages.map(lambda m: None if m is None else hashlib.sha256(json.dumps(json.loads(m), sort_keys=True).encode()).hexdigest())


def seed(key: Column, attempt: Column, temperature: float, policy: str | int = "fixed") -> Column:
    """The seed to send: none at temperature 0 or for random ones, the policy's own number, or one from the page's input."""
    if not temperature or policy == "random":
        return F.lit(None).cast("bigint")
    return F.lit(policy).cast("bigint") if isinstance(policy, int) else seed_for(key, attempt)


# -- parameters ---------------------------------------------------------------------------------------------------

#: Temperature and further parameters by stage.
STAGES = {
    "transcribe": (0.7, {"top_p": 0.8, "top_k": 20, "presence_penalty": 1.5}),
    "classify_figure": (0.7, {"top_p": 0.8, "top_k": 20, "presence_penalty": 1.5}),
    "structured": (0.7, {"top_p": 0.8, "top_k": 20, "presence_penalty": 1.5}),
    "structured_page": (0, {"presence_penalty": 0.3}),
}
#: Models that think unless told not to, what tells them, and the stage that never does.
THINKS = re.compile(r"qwen[\s._-]*3\.?[5-9]", re.I)
NO_THINKING = {"reasoning": {"enabled": False}, "chat_template_kwargs": {"enable_thinking": False}}
BARE = "structured_page"


def stage_parameters(model: str, stage: str) -> dict:
    """{"temperature", "extra_params"} of a stage for a model; extra_params is None where there are none."""
    temperature, extra = STAGES[stage]
    extra = {**extra, **(NO_THINKING if stage != BARE and THINKS.search(model) else {})}
    return {"temperature": temperature, "extra_params": extra or None}


def retry_parameters(first: dict | None, enforce: bool, schema: dict, penalty: float = 0.3, dialect: str = "both") -> dict:
    """Parameters of the retry: the first pass's, the retry's penalty and, if the schema is enforced, the field that each
    kind of server reads it from."""
    fields = {"structured_outputs": {"json": schema}} if dialect in ("both", "vllm") else {}
    fields |= {"json_schema": schema} if dialect in ("both", "llamacpp") else {}
    return {**(first or {}), **(fields if enforce else {}), **({"presence_penalty": penalty} if penalty else {})}


def parameter_table(spark, models: list[str]):
    """model, stage, temperature, extra (JSON): the small dimension that attempts join."""
    rows = [(m, s, float(p["temperature"]), json.dumps(p["extra_params"], sort_keys=True)) for m in models for s in STAGES for p in [stage_parameters(m, s)]]
    return spark.createDataFrame(rows, "model string, stage string, temperature double, extra string")
