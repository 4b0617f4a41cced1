"""Matching backends: a registry by name, recorded replies, token overlap, and models.

A backend answers prompts: replies(prompts, attempt) takes a table with a prompt column and
returns it with response added, and in_tokens, out_tokens and seconds where it knows them.
Models are asked on the executors, batch by batch; their clients are imported there, when
first used, and are not part of this library.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BACKENDS: dict[str, type] = {}
#: What a reply may tell of its making.
#: peak_mb: the most memory that the answering Python worker has held so far.
USAGE = {"in_tokens": "bigint", "out_tokens": "bigint", "seconds": "double", "peak_mb": "double"}
REPLY_TOKENS = 1024
#: USD per million tokens, in and out.
PRICES: dict[str, tuple[float, float]] = {"example-small": (0.5, 2.0), "example-large": (5.0, 20.0)}


class Backend:
    """Subclasses register under `backend=`; default_retries holds where None is given."""

    name = ""
    default_retries = 10
    needs_key: str | None = None

    def __init_subclass__(cls, backend: str | None = None, **kw):
        super().__init_subclass__(**kw)
        if backend:
            cls.name = backend
            BACKENDS[backend] = cls

    def __init__(self, max_retries: int | None = None, window: int = 5, prompt: str | None = None, model: str | None = None, api_key: str | None = None, **options):
        from .prompts import template

        self.template = template(prompt) and (prompt or "primary")
        self.max_retries = self.default_retries if max_retries is None else max_retries
        self.window, self.model, self.options = window, model, options
        self.api_key = api_key or (os.environ.get(self.needs_key) if self.needs_key else None)
        if self.needs_key and not self.api_key:
            raise ValueError(f"{self.name} needs an API key: an argument, or {self.needs_key}")

    def replies(self, prompts: DataFrame, attempt: int) -> DataFrame:
        raise NotImplementedError

    def tokens(self, column):
        """Estimated tokens of a text column: by a vocabulary file for the library tokenizers (option tokenizer=path), else four characters each."""
        from .prompts import estimated_tokens

        path = self.options.get("tokenizer")
        if path is None:
            return estimated_tokens(column)

        def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            for b in batches:
                yield pa.array([len(e.ids) for e in t.encode_batch(["" if x is None else x for x in b.to_pylist()], add_special_tokens=False)], pa.int64())

        return F.arrow_udf(count, "long")(column)


class Replay(Backend, backend="replay"):
    """Recorded replies: a table of keys, attempt and response."""

    def __init__(self, recorded: DataFrame, keys: list[str], **kw):
        super().__init__(**kw)
        self.recorded, self.keys = recorded, keys

    def replies(self, prompts, attempt):
        some = self.recorded.where(F.col("attempt") == attempt).select(*self.keys, F.coalesce("response", F.lit("")).alias("response"))
        return prompts.join(some, self.keys, "left").na.fill("", ["response"])


class Lexical(Backend, backend="lexical"):
    """Replies by shared words: the numbered segments of which at least `least` of the words are in the marked part."""

    def __init__(self, least: float = 0.5, **kw):
        super().__init__(**kw)
        self.least = least

    def replies(self, prompts, attempt):
        from tessera.functions import text

        from .prompts import template

        t = template(self.template)
        quote = lambda x: "".join("\\" + c if not c.isalnum() else c for c in x)
        # the marks also stand in the instructions: the last ones are the recall's
        marked = F.regexp_extract("prompt", f"(?s).*{quote(t.start)}(.*?){quote(t.end)}", 1)
        listed = F.regexp_extract("prompt", r"(?s)(?:Numbered segments:|<numbered_segments>)\n(.*?)\n(?:\n|</numbered_segments>)", 1)
        rows = F.split(listed, "\n")
        own = text.tokens(marked)

        def shares(x):
            words = text.tokens(F.regexp_replace(x, r"^\d+\. ", ""))
            return F.coalesce(F.try_divide(F.size(F.array_intersect(words, own)), F.size(words)), F.lit(0.0)) >= self.least

        numbers = F.filter(F.transform(F.filter(rows, shares), lambda x: F.regexp_extract(x, r"^(\d+)\. ", 1)), lambda x: x != "")
        return prompts.withColumn("response", F.when(F.size(numbers) > 0, F.concat(F.lit("<"), F.array_join(numbers, ", "), F.lit(">"))).otherwise(F.lit("<NONE>")))


class Adapter(Backend):
    """A model behind a function: make(options) is called once in each task and returns ask(texts), which gives a reply for each: its text, or (text, in_tokens, out_tokens)."""

    make: Callable | None = None
    default_model: str | None = None

    def __init__(self, make: Callable | None = None, batch: int = 64, **kw):
        super().__init__(**kw)
        self.make, self.batch = make or self.make, batch
        self.model = self.model or self.default_model

    def replies(self, prompts, attempt):
        make, batch, options = self.make, self.batch, {**self.options, "model": self.model, "api_key": self.api_key, "attempt": attempt}
        schema = T.StructType([*prompts.schema.fields, T.StructField("response", T.StringType()), *(T.StructField(c, T._parse_datatype_string(t)) for c, t in USAGE.items())])

        from .usage import peak_mb

        def run(batches: Iterator[pa.RecordBatch]):
            ask = None
            for b in batches:
                ask = ask or make(options)
                texts, got = b.column("prompt").to_pylist(), []
                for a in range(0, len(texts), batch):
                    began, some = time.perf_counter(), texts[a : a + batch]
                    replies = [r if isinstance(r, tuple) else (r, None, None) for r in ask(some)]
                    each = (time.perf_counter() - began) / len(some)
                    peak = peak_mb()
                    got += [(*r, each, peak) for r in replies]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.record_batch([*b.columns, *(pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True))] if got else [*b.columns, *(pa.array([], t) for t in kinds)], [*b.schema.names, "response", *USAGE])

        return prompts.mapInArrow(run, schema)


class Model(Adapter, backend="model"):
    """Any callable."""


def _chat(text: str) -> list[dict]:
    return [{"role": "user", "content": text}]


def _ask_messages(options):
    """The messages API of the client `anthropic`."""
    from anthropic import Anthropic

    client = Anthropic(api_key=options["api_key"])

    def one(text):
        r = client.messages.create(model=options["model"], max_tokens=options.get("max_new_tokens", REPLY_TOKENS), messages=_chat(text))
        return "".join(x.text for x in r.content if getattr(x, "text", None)), r.usage.input_tokens, r.usage.output_tokens

    return lambda texts: [one(x) for x in texts]


def _ask_responses(options):
    """The responses API of the client `openai`."""
    from openai import OpenAI

    client = OpenAI(api_key=options["api_key"])

    def one(text):
        r = client.responses.create(model=options["model"], input=text)
        return r.output_text, r.usage.input_tokens, r.usage.output_tokens

    return lambda texts: [one(x) for x in texts]


def _ask_vllm(options):
    """A batch at a time on the GPUs of a task's machine, by `vllm`."""
    from vllm import LLM, SamplingParams

    fixed = {k: options[k] for k in ("tensor_parallel_size", "gpu_memory_utilization", "max_model_len") if options.get(k)}
    llm, how = LLM(model=options["model"], **fixed), SamplingParams(temperature=0.0, max_tokens=options.get("max_new_tokens", REPLY_TOKENS))

    def ask(texts):
        return [(o.outputs[0].text, len(o.prompt_token_ids or []), len(o.outputs[0].token_ids)) for o in llm.chat([_chat(x) for x in texts], how, use_tqdm=False)]

    return ask


def _ask_transformers(options):
    """A text-generation pipeline of `transformers`."""
    from transformers import pipeline

    pipe = pipeline("text-generation", model=options["model"], token=options["api_key"], device_map=options.get("device", "auto"))

    def ask(texts):
        out = pipe([_chat(x) for x in texts], max_new_tokens=options.get("max_new_tokens", REPLY_TOKENS), return_full_text=False, batch_size=len(texts))
        replies = [str(r[0]["generated_text"]) for r in out]
        return [(r, len(pipe.tokenizer.encode(x)), len(pipe.tokenizer.encode(r))) for x, r in zip(texts, replies, strict=True)]

    return ask


def _ask_mlx(options):
    """One at a time on Apple silicon, by `mlx_lm`."""
    from mlx_lm import generate, load

    model, tokenizer = load(options["model"])

    def one(text):
        prompt = tokenizer.apply_chat_template(_chat(text), add_generation_prompt=True)
        reply = generate(model, tokenizer, prompt=prompt, max_tokens=options.get("max_new_tokens", REPLY_TOKENS))
        return reply, len(prompt), len(tokenizer.encode(reply))

    return lambda texts: [one(x) for x in texts]


class _Named(Adapter):
    """A model that must be named."""

    def __init__(self, **kw):
        super().__init__(**kw)
        if self.make is type(self).make and not self.model:
            raise ValueError(f"{self.name} needs a model: model=...")


class HostedA(_Named, backend="anthropic"):
    needs_key, make = "ANTHROPIC_API_KEY", staticmethod(_ask_messages)


class HostedB(_Named, backend="openai"):
    needs_key, make = "OPENAI_API_KEY", staticmethod(_ask_responses)


class LocalHub(_Named, backend="huggingface"):
    needs_key, make = "HF_TOKEN", staticmethod(_ask_transformers)


class LocalGpu(_Named, backend="cuda"):
    make = staticmethod(_ask_vllm)

    def __init__(self, max_retries=None, **kw):
        super().__init__(max_retries=max_retries or self.default_retries, **kw)


class LocalMac(LocalGpu, backend="mac"):
    make = staticmethod(_ask_mlx)


def get_backend(name: str, **options) -> Backend:
    if name not in BACKENDS:
        raise ValueError(f"unknown matcher {name!r}; there are {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name](**options)


def price_table(spark, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    rows = [(m, a, b) for m, (a, b) in (PRICES if prices is None else prices).items()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["model", "price_in", "price_out"]))


__all__ = ["Adapter", "BACKENDS", "Backend", "Lexical", "Model", "PRICES", "Replay", "USAGE", "get_backend", "price_table"]
