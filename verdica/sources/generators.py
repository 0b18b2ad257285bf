"""Sources of responses.

A generator turns prompts into a table of responses.  The mock is an expression; those that
call a model run in Arrow batches with one client for each task.  Write generations to a
table before grading them, so that no retry asks a model again.
"""

from __future__ import annotations

import json
import os
import random
import time
import urllib.request

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import word_count

MODELS = {"gemini": "gemini-2.5-flash", "qwen": "qwen3:8b", "mock": "mock"}
TRIES = 8


def prompt(problem: Column) -> Column:
    """What a model is asked."""
    return F.concat(F.lit("Solve the following problem briefly, show the main steps, and put the final answer in \\boxed{}.\n\n"), problem)


def retrying(call, transient: tuple, tries: int = TRIES, sleep=time.sleep):
    """Calls until it works; waits twice as long after each transient error."""
    last = None
    for n in range(tries):
        try:
            return call()
        except transient as error:
            last = error
            if n < tries - 1:
                sleep(2**n + random.uniform(0.5, 1.5))
    raise RuntimeError(f"gave up after {tries} tries: {last}") from last


def merged(thinking: Column, response: Column) -> Column:
    """A model's thoughts before its response, where there are any."""
    return F.when(F.coalesce(thinking, F.lit("")) != "", F.concat(thinking, F.lit("\n\n"), F.coalesce(response, F.lit("")))).otherwise(F.coalesce(response, F.lit("")))


class Mock:
    """Responses that are right for a fixed share of prompts, by a digest; marked as synthetic."""

    name, synthetic = "mock", True

    def __init__(self, accuracy: float = 0.6, seed: int = 0):
        self.accuracy, self.seed = accuracy, seed

    def roll(self, prompt: Column, draw: Column, temperature: float) -> tuple[Column, Column]:
        """(the roll as an integer of 32 bits, the roll between 0 and 1)."""
        draw = draw if temperature > 0 else F.lit(0)
        digest = F.sha2(F.concat_ws("|", F.lit(str(self.seed)), F.lit(str(float(temperature))), draw.cast("string"), prompt), 256)
        whole = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
        return whole, whole / F.lit(4294967295.0)

    def generate(self, rows: DataFrame, temperature: float = 0.0, max_tokens: int = 16384) -> DataFrame:
        """``rows`` (prompt, answer, sample_index) with the columns of a generation."""
        _, roll = self.roll(F.col("prompt"), F.col("sample_index"), temperature)
        answer = F.when(roll < self.accuracy, F.coalesce("answer", F.lit("42"))).otherwise(F.format_string("%.3f", roll))
        text = F.concat(
            F.lit("I go through this in steps.\nWhat is asked for comes first.\n\\[\nx = "), answer,
            F.lit("\n\\]\nThe arithmetic agrees with that.\nHence the final answer is \\boxed{"), answer, F.lit("}."),
        )
        out = rows.withColumn("text", text).withColumns({"prompt_tokens": word_count(F.col("prompt")), "eval_tokens": word_count(F.col("text"))})
        return out.withColumns({"total_tokens": F.col("prompt_tokens") + F.col("eval_tokens"), "warning": F.lit(None).cast("string")})


class Remote:
    """A generator that asks a model for each prompt; subclasses give ``connect``."""

    synthetic = False

    def connect(self):
        """A function of (prompt, temperature, max_tokens) to a dict of the generation's fields; made once in each task."""
        raise NotImplementedError

    def generate(self, rows: DataFrame, temperature: float = 0.0, max_tokens: int = 16384) -> DataFrame:
        connect, names = self.connect, [f.split()[0] for f in schemas.GENERATION.split(", ")]
        at = rows.columns.index("prompt")

        def run(batches):
            ask = connect()
            for batch in batches:
                made = [ask(p, temperature, max_tokens) for p in batch.column(at).to_pylist()]
                types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                new = [pa.array([m.get(n) if t == pa.string() else int(m.get(n) or 0) for m in made], t) for n, t in zip(names, types)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(run, f"{fields}, {schemas.GENERATION}")


class Ollama(Remote):
    """A local server that speaks the Ollama protocol."""

    name = "qwen"

    def __init__(self, model: str | None = None, host: str | None = None, timeout: int = 600, think: str = "merge"):
        if think not in ("merge", "off"):
            raise ValueError(f"think is merge or off, not {think!r}")
        self.model, self.timeout, self.think = model or MODELS["qwen"], timeout, think
        self.host = os.environ.get("OLLAMA_HOST", "http://localhost:11434") if host is None else host

    def body(self, prompt: str, temperature: float, max_tokens: int) -> dict:
        asked = {"options": {"num_predict": max_tokens, "temperature": temperature}, "prompt": prompt, "stream": False, "model": self.model}
        return asked | ({"think": False} if self.think == "off" else {})

    @staticmethod
    def read(said: dict) -> dict:
        parts = [said.get("thinking") or "", said.get("response") or ""]
        text = "\n\n".join(parts) if parts[0] else parts[1]
        asked, made = said.get("prompt_eval_count") or 0, said.get("eval_count") or 0
        return {"text": text, "prompt_tokens": asked, "eval_tokens": made, "total_tokens": asked + made, "warning": None if text else f"no text: {said.get('done_reason')}"}

    def connect(self):
        def ask(prompt: str, temperature: float, max_tokens: int) -> dict:
            data = json.dumps(self.body(prompt, temperature, max_tokens)).encode()
            request = urllib.request.Request(f"{self.host}/api/generate", data, {"Content-Type": "application/json"})

            def call():
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return self.read(json.load(answer))

            return retrying(call, (OSError, TimeoutError))

        return ask


class Gemini(Remote):
    """The Gemini API, where its client library is installed and GEMINI_API_KEY is set."""

    name = "gemini"

    def __init__(self, model: str | None = None):
        if not os.environ.get("GEMINI_API_KEY"):
            raise RuntimeError("GEMINI_API_KEY is not set")
        self.model = model or MODELS["gemini"]

    def connect(self):
        from google import genai

        client = genai.Client(api_key=os.environ["GEMINI_API_KEY"])

        def ask(prompt: str, temperature: float, max_tokens: int) -> dict:
            def call():
                said = client.models.generate_content(model=self.model, contents=prompt, config={"temperature": temperature, "max_output_tokens": max_tokens})
                used = said.usage_metadata
                asked, made, total = (getattr(used, n, None) or 0 for n in ("prompt_token_count", "candidates_token_count", "total_token_count"))
                reason = said.candidates[0].finish_reason if said.candidates else "no candidates"
                return {"text": said.text or "", "prompt_tokens": asked, "eval_tokens": made, "total_tokens": total, "warning": None if said.text else f"no text: {reason}"}

            return retrying(call, (genai.errors.APIError, OSError))

        return ask


GENERATORS = {"mock": Mock, "qwen": Ollama, "gemini": Gemini}


def build(name: str, **options):
    if name not in GENERATORS:
        raise ValueError(f"unknown generator {name!r}; there are {', '.join(sorted(GENERATORS))}")
    return GENERATORS[name](**options)
