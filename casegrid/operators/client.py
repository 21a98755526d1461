"""Calling a model for each prompt.  Clients are plain Python objects; the call is the one Python step of the pipeline."""

from __future__ import annotations

import json
import math
import os
import subprocess
import tempfile
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.operators.prompt import DEFAULT_MODELS, cost, system_prompt
from casegrid.plans.tables import new_path, written

TRIES, TIMEOUT, PAUSE = 4, 600, 2.0
#: Environment variables that each provider needs.
NEEDS = {"azure": ("AZURE_OPENAI_ENDPOINT", "AZURE_OPENAI_API_KEY"), "claude": ("CLAUDE_API_KEY",), "openai": ("OPENAI_API_KEY",), "gemini": ("GEMINI_API_KEY",), "ollama": (), "mlx": ()}


class Client(Protocol):
    def call(self, prompt: str) -> dict:
        """text, prompt_tokens, completion_tokens"""


def estimate(text: str) -> int:
    return math.ceil(len(text) / 4)


CITED_TASK = "Extract the line list of cases from this outbreak narrative."
#: Providers that a prompt leaves this machine for.
EXTERNAL = ("azure", "claude", "openai", "gemini")


def require_approval(provider: str, approved: bool) -> None:
    """Raises unless sending documents to an external provider was approved."""
    if provider in EXTERNAL and not approved:
        raise PermissionError(f"sending documents to {provider} was not approved")


def require_env(provider: str) -> None:
    """Raises with every variable that is missing, before any job starts."""
    missing = [v for v in NEEDS[provider] if not os.environ.get(v)]
    if missing:
        raise ValueError("missing environment variables: " + ", ".join(missing))


def passing(status: int) -> bool:
    """Whether a request with this status may succeed later."""
    return status in (408, 429) or status >= 500


def asked_pause(headers: Mapping[str, str] | None, otherwise: float) -> float:
    """Seconds of a Retry-After header, up to TIMEOUT; dates, and anything else, count as none."""
    asked = (headers or {}).get("Retry-After") or ""
    return min(float(asked), TIMEOUT) if asked.strip().isdigit() else otherwise


@dataclass
class FakeClient:
    """Answers from a table, else with a fixed text; for tests."""

    answers: dict[str, str] = field(default_factory=dict)
    default: str = "<linelist>[]</linelist>"

    def call(self, prompt: str) -> dict:
        text = next((a for key, a in self.answers.items() if key in prompt), self.default)
        return {"text": text, "prompt_tokens": estimate(prompt), "completion_tokens": estimate(text)}


@dataclass
class HttpClient:
    """One of the HTTP providers; at most TRIES attempts, each of TIMEOUT seconds at most, with growing pauses between."""

    provider: str
    model: str | None = None
    temperature: float = 0.1
    max_tokens: int = 25000

    def request(self, prompt: str) -> tuple[str, dict, dict]:
        """URL, headers and body."""
        model, env = self.model or DEFAULT_MODELS[self.provider], os.environ.get
        chat = {"messages": [{"role": "user", "content": prompt}]}
        if self.provider == "azure":
            url = f"{env('AZURE_OPENAI_ENDPOINT')}/openai/deployments/{model}/chat/completions?api-version={env('AZURE_OPENAI_API_VERSION', '2025-01-01-preview')}"
            return url, {"api-key": env("AZURE_OPENAI_API_KEY", "")}, chat | {"max_completion_tokens": self.max_tokens, "reasoning_effort": "low"}
        if self.provider == "claude":
            return "https://api.anthropic.com/v1/messages", {"x-api-key": env("CLAUDE_API_KEY", ""), "anthropic-version": "2023-06-01"}, chat | {"model": model, "temperature": self.temperature, "max_tokens": self.max_tokens}
        if self.provider == "openai":
            return "https://api.openai.com/v1/chat/completions", {"Authorization": f"Bearer {env('OPENAI_API_KEY', '')}"}, chat | {"model": model, "temperature": self.temperature, "max_tokens": self.max_tokens}
        if self.provider == "gemini":
            url = f"https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent?key={env('GEMINI_API_KEY', '')}"
            return url, {}, {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"temperature": self.temperature, "maxOutputTokens": self.max_tokens}}
        if self.provider == "ollama":
            return f"{env('OLLAMA_HOST', 'http://localhost:11434')}/api/generate", {}, {"model": model, "prompt": prompt, "stream": False, "options": {"temperature": self.temperature, "num_predict": self.max_tokens}}
        raise ValueError(f"unknown provider {self.provider}")

    def answer(self, prompt: str, body: dict) -> dict:
        """text and usage of a response body; tokens are estimated where the provider gives none."""
        if self.provider in ("azure", "openai"):
            text, usage = body["choices"][0]["message"]["content"], body.get("usage") or {}
            n = usage.get("prompt_tokens"), usage.get("completion_tokens")
        elif self.provider == "claude":
            text, usage = body["content"][0]["text"], body.get("usage") or {}
            n = usage.get("input_tokens"), usage.get("output_tokens")
        elif self.provider == "gemini":
            text, usage = "".join(p["text"] for p in body["candidates"][0]["content"]["parts"]), body.get("usageMetadata") or {}
            n = usage.get("promptTokenCount"), usage.get("candidatesTokenCount")
        else:
            text, n = body["response"], (None, None)
        return {"text": text, "prompt_tokens": estimate(prompt) if n[0] is None else n[0], "completion_tokens": estimate(text) if n[1] is None else n[1]}

    def call(self, prompt: str) -> dict:
        return self.answer(prompt, self.send(*self.request(prompt)))

    def send(self, url: str, headers: dict, body: dict) -> dict:
        """The response's JSON.  A connection that fails, and a status that may pass, is tried again after a growing pause, or the one
        that the server asks for; any other status raises at once."""
        for k in range(TRIES):
            try:
                request = urllib.request.Request(url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=TIMEOUT) as r:
                    return json.loads(r.read())
            except urllib.error.HTTPError as e:
                if k + 1 == TRIES or not passing(e.code):
                    raise
                time.sleep(asked_pause(e.headers, PAUSE * 2**k))
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if k + 1 == TRIES:
                    raise
                time.sleep(PAUSE * 2**k)
        raise AssertionError

    def cited_request(self, instructions: str, document: str) -> tuple[str, dict, dict]:
        """URL, headers and body of a request whose answer cites the document; of one provider only."""
        if self.provider != "claude":
            raise ValueError(f"{self.provider} has no cited requests")
        url, headers, body = self.request("")
        source = {"type": "text", "media_type": "text/plain", "data": document}
        content = [{"type": "document", "source": source, "title": "Outbreak narrative", "citations": {"enabled": True}}, {"type": "text", "text": CITED_TASK}]
        return url, headers, body | {"system": instructions, "messages": [{"role": "user", "content": content}]}

    def call_cited(self, instructions: str, document: str) -> dict:
        """text, blocks (see ``blocks``) and usage of a cited answer."""
        body = self.send(*self.cited_request(instructions, document))
        usage, parts = body["usage"], blocks(body["content"])
        return {"text": "".join(p["text"] for p in parts), "blocks": parts, "prompt_tokens": usage["input_tokens"], "completion_tokens": usage["output_tokens"]}


@dataclass
class CommandClient:
    """A local program that gets ``@file`` with the prompt and prints the answer; output and errors are joined."""

    command: list[str]

    def call(self, prompt: str) -> dict:
        with tempfile.NamedTemporaryFile("w", suffix=".txt", delete=False) as f:
            f.write(prompt)
        try:
            done = subprocess.run([*self.command, f"@{f.name}"], stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, check=False)
        finally:
            os.unlink(f.name)
        if done.returncode:
            raise RuntimeError(f"exit code {done.returncode}: {done.stdout[-500:]}")
        return {"text": done.stdout, "prompt_tokens": estimate(prompt), "completion_tokens": estimate(done.stdout)}


def blocks(content: list[dict]) -> list[dict]:
    """Text blocks of a cited response with their offsets in the joined text."""
    out, at = [], 0
    for b in content:
        if b.get("type") == "text":
            cited = [{k: c.get(k) for k in ("cited_text", "start_char_index", "end_char_index")} for c in b.get("citations") or []]
            out.append({"text": b["text"], "start": at, "end": at + len(b["text"]), "citations": cited})
            at += len(b["text"])
    return out


BLOCKS = "array<struct<text:string,start:int,end:int,citations:array<struct<cited_text:string,start_char_index:int,end_char_index:int>>>>"


ANSWER = f"key string, response string, blocks {BLOCKS}, prompt_tokens bigint, completion_tokens bigint, status string, error string"
#: Prompts whose answers are not yet in the ledger, of all tasks that run together, and calls at once in a task.
EVERY, AT_ONCE = 1_000, 4
#: Jobs that the prompts of one run are dealt to at most, and prompts that a task takes at least for each of its calls at once.
JOBS, LEAST = 16, 16


def _answered(asked: DataFrame, call: Callable[[dict], dict], ledger: str, every: int, at_once: int) -> DataFrame:
    """The ledger's rows (ANSWER) after every row of ``asked`` (key, prompt, instructions; keys distinct) that it has no answer
    for was asked once more.  A call that fails is a row with its error; the next run asks it again."""
    spark = asked.sparkSession

    def known() -> DataFrame | None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.schema(ANSWER).parquet(ledger)

    def one(row: dict) -> dict:
        try:
            if not (row["prompt"] or "").strip():
                raise ValueError("prompt must not be empty")
            got = call(row)
            return {"key": row["key"], "response": got["text"], "blocks": got.get("blocks"), "prompt_tokens": got["prompt_tokens"], "completion_tokens": got["completion_tokens"], "status": "ok", "error": None}
        except Exception as e:  # noqa: BLE001  whatever a client raises belongs to its row
            return {"key": row["key"], "response": None, "blocks": None, "prompt_tokens": None, "completion_tokens": None, "status": "failed", "error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for p in batches:
                rows = p.to_dict("records")
                for k in range(0, len(rows), 4 * at_once):
                    yield pd.DataFrame([*pool.map(one, rows[k : k + 4 * at_once])], columns=[c.split(" ")[0] for c in ANSWER_COLUMNS])

    had = known()
    left = asked if had is None else asked.join(had.filter("status = 'ok'").select("key"), "key", "left_anti")
    left = written(left)
    jobs, path = min(-(-left.count() // every), JOBS), new_path(spark)
    if jobs:
        # a folder for each job, so that none reads the prompts of the others
        left.withColumn("_job", F.pmod(F.xxhash64("key"), F.lit(jobs))).repartition(jobs, "_job").write.partitionBy("_job").parquet(path)
        sizes = spark.read.parquet(path).groupBy("_job").count().orderBy("_job").collect()
        share = max(every // spark.sparkContext.defaultParallelism, LEAST * at_once)
        for job, n in sizes:
            part, tasks = spark.read.schema(left.schema).parquet(f"{path}/_job={job}"), -(-n // share)
            part = part.repartition(tasks, "key") if tasks > 1 else part.coalesce(1)
            # by this version of Hadoop's committer the answers of a task are in the ledger when it ends, whatever becomes of the others
            part.mapInPandas(run, ANSWER).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(ledger)
    had = known()
    if had is None:
        return spark.createDataFrame([], ANSWER)
    # an answer before any failure
    best = had.groupBy("key").agg(F.min_by(F.struct(*(c.split(" ")[0] for c in ANSWER_COLUMNS[1:])), F.when(F.col("status") == "ok", 0).otherwise(1)).alias("a"))
    return best.select("key", "a.*")


ANSWER_COLUMNS = ("key string", "response string", "blocks", "prompt_tokens bigint", "completion_tokens bigint", "status string", "error string")


def _called(rows: DataFrame, call: Callable[[dict], dict], identity: str, ledger: str | None, every: int, at_once: int) -> DataFrame:
    """``rows`` (prompt, _instructions and others) with response, blocks, prompt_tokens, completion_tokens, status and error; rows
    with one prompt are asked once.  Without a ledger it lies among the intermediate tables of this session."""
    keyed = rows.withColumn("_key", F.sha2(F.concat_ws("\x01", F.lit(identity), F.coalesce("_instructions", F.lit("")), F.coalesce("prompt", F.lit(""))), 256))
    keyed = written(keyed)
    asked = keyed.select(F.col("_key").alias("key"), "prompt", F.col("_instructions").alias("instructions")).dropDuplicates(["key"])
    answers = _answered(asked, call, ledger or new_path(rows.sparkSession), every, at_once)
    return written(keyed.join(answers.withColumnRenamed("key", "_key"), "_key", "left").drop("_key", "_instructions"))


def cited_answers(docs: DataFrame, client: HttpClient, instructions: str, approved: bool = False, ledger: str | None = None, every: int = EVERY, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, response, blocks (text blocks with their places and citations), prompt_tokens, completion_tokens, status and
    error of each document's cited answer; see ``call_model``."""
    if isinstance(client, HttpClient):
        require_approval(client.provider, approved)
        require_env(client.provider)
    rows = docs.select("doc_id", F.col("content").alias("prompt"), F.lit(instructions).alias("_instructions"))
    identity = f"cited:{getattr(client, 'provider', type(client).__name__)}:{getattr(client, 'model', None)}"
    return _called(rows, lambda row: client.call_cited(row["instructions"], row["prompt"]), identity, ledger, every, at_once).drop("prompt")


def call_model(prompts: DataFrame, client: Client, provider: str, model: str | None = None, raw: bool = True, prompt_type: str = "ebola_narrative", approved: bool = False, ledger: str | None = None, every: int = EVERY, at_once: int = AT_ONCE) -> DataFrame:
    """``prompts`` with response, prompt_tokens, completion_tokens, status (ok or failed), error, total_tokens, cost, model and
    provider.  If not ``raw`` a prompt is a document that is bound to the bundled template.  Before any job starts an HTTP client
    needs its environment variables, and for an external provider approval.

    Answers go to ``ledger``, a folder that all executors share, under a hash of provider, model and prompt, whenever a task ends; tasks
    that run together have about ``every`` prompts (LEAST for each call at a time, if that is more), with ``at_once`` calls at a
    time in each.  What it has answered is not asked again, so a run that was stopped goes on where it stood, but for the tasks that ran then.  A prompt that is null or blank, and a call that fails, is a failed row and stops no other;
    the next run with this ledger asks it again."""
    if isinstance(client, HttpClient):
        require_approval(provider, approved)
        require_env(provider)
    model = model or DEFAULT_MODELS.get(provider)
    if not raw:
        prompts = prompts.withColumn("prompt", F.when(F.trim("prompt") != "", system_prompt("prompt", prompt_type)))
    out = _called(prompts.withColumn("_instructions", F.lit("")), lambda row: client.call(row["prompt"]), f"{provider}:{model}", ledger, every, at_once)
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return out.drop("blocks").select("*", total.alias("total_tokens"), cost(F.lit(model), F.col("prompt_tokens"), F.col("completion_tokens")).alias("cost"), F.lit(model).alias("model"), F.lit(provider).alias("provider"))
