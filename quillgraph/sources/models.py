"""Language model connectors.  The engine needs one method, ``complete(prompt) -> str``; tests use stubs."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORTED = {"gpt4": "gpt-4o-mini", "llama3": "llama3", "mistral": "mistral"}


class Model(Protocol):
    def complete(self, prompt: str) -> str: ...


@dataclass
class OllamaModel:
    name: str = "llama3"
    url: str = "http://localhost:11434"
    timeout: float = 90
    temperature: float = 0.0

    def _post(self, path: str, body: dict | None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def complete(self, prompt: str) -> str:
        return self._post("/api/generate", {"model": self.name, "prompt": prompt, "stream": False, "options": {"temperature": self.temperature}}).get("response", "").strip()

    def names(self) -> list[str]:
        return [m.get("name", "") for m in self._post("/api/tags", None).get("models", [])]


@dataclass
class OpenAIModel:
    name: str = "gpt-4o-mini"
    key: str = ""
    temperature: float = 0.0

    def complete(self, prompt: str) -> str:
        try:
            from openai import OpenAI
        except ImportError as e:
            raise ImportError("this connector needs the package openai") from e
        answer = OpenAI(api_key=self.key).chat.completions.create(model=self.name, temperature=self.temperature, messages=[{"role": "user", "content": prompt}])
        return (answer.choices[0].message.content or "").strip()


@dataclass
class StubModel:
    """Answers by a function of the prompt."""

    answer: Callable[[str], str] = lambda prompt: "{}"
    asked: list[str] = field(default_factory=list)

    def complete(self, prompt: str) -> str:
        self.asked.append(prompt)
        return self.answer(prompt)


def has_model(names: Column, wanted: Column) -> Column:
    """A model is there by its name, or by its name with any tag."""
    return F.exists(names, lambda n: (n == wanted) | n.startswith(F.concat(wanted, F.lit(":"))))


def available(llm: str, ollama: OllamaModel | None = None, openai_key: str = "") -> tuple[bool, str]:
    """Whether the chosen model can be used, checked on the driver before a job starts, and why not."""
    if llm == "gpt4":
        return (True, "") if openai_key else (False, "no key for the OpenAI model")
    if llm not in SUPPORTED:
        return False, f"unsupported model: {llm}"
    try:
        names = (ollama or OllamaModel(SUPPORTED[llm])).names()
    except OSError as e:
        return False, f"the model server can't be reached: {e}"
    wanted = SUPPORTED[llm]
    return (True, "") if any(n == wanted or n.startswith(wanted + ":") for n in names) else (False, f"model {wanted} is not installed")


ENTITY_PROMPT = 'List the named entities of the text as JSON {{"entities": [{{"label": "Person|Organization|Location|Concept", "name": "..."}}]}}.\n\n{text}'
RELATION_PROMPT = 'List relations between these entities: {names}. Answer as JSON {{"relations": [{{"source": "...", "target": "...", "type": "..."}}]}}.\n\n{text}'


def answers(prompts: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """``prompts`` with an ``answer`` in place of ``prompt``; the client is built once for each task, and one failed
    call leaves an ``error`` in its row instead of failing every document."""
    names = [c for c in prompts.columns if c != "prompt"]
    schema = ", ".join([*(f"`{c}` {prompts.schema[c].dataType.simpleString()}" for c in names), "answer string", "error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            said, failed = [], []
            for prompt in batch.column("prompt").to_pylist():
                try:
                    said.append(model.complete(prompt))
                    failed.append(None)
                except Exception as e:  # noqa: BLE001  any client error belongs to its row
                    said.append(None)
                    failed.append(str(e))
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(said, pa.string()), pa.array(failed, pa.string())], names=[*names, "answer", "error"])

    return prompts.mapInArrow(run, schema)


def entity_prompts(chunks: DataFrame) -> DataFrame:
    before, after = ENTITY_PROMPT.format(text="\0").split("\0")
    return chunks.select("document_id", "chunk_id", "start_index", "end_index", F.concat(F.lit(before), "text", F.lit(after)).alias("prompt"))


def relation_prompts(windows: DataFrame, within: DataFrame) -> DataFrame:
    """Prompts of windows with two entities or more; the count is taken before any model is asked."""
    names = within.groupBy("document_id", F.col("window_id").alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("e")).where(F.size("e") >= 2)
    rows = windows.join(names, ["document_id", "chunk_id"])
    a, b, c = RELATION_PROMPT.format(names="\0", text="\0").split("\0")
    told = F.array_join(F.transform("e", lambda x: x["name"]), ", ")
    return rows.select("document_id", "chunk_id", F.concat(F.lit(a), told, F.lit(b), F.coalesce("analysis_text", "text"), F.lit(c)).alias("prompt"))
