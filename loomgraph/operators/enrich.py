"""Descriptions of nodes by a language model, over HTTP or through a client that the caller injects.

A client is a function from a list of prompts to a list of answers, made on the worker by a factory; without one, a
mock answers offline. Prompts go in batches; a batch's answers are parsed at once.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.case import organize_by_path

Client = Callable[[list[str]], list[str]]
#: Requests for one prompt, seconds for each, and seconds between the first two.
TRIES, TIMEOUT, PAUSE = 3, 60, 0.5


@dataclass(frozen=True)
class Config:
    provider: str = "openai_compatible"
    model: str = "mock"
    base_url: str = ""
    max_tokens: int = 4096
    temperature: float = 0.7
    max_concurrent: int = 3


def mock_client() -> Client:
    """Names the first words of each prompt's last line."""

    def answer(prompt: str) -> str:
        name = prompt.rstrip().rsplit("\n", 1)[-1]
        return "Thinking.\n" + json.dumps([{"entity_name": name, "features": ["handle " + name], "description": f"about {name}"}])

    return lambda prompts: [answer(p) for p in prompts]


def http_client(config: Config, key: str = "", opener: Callable | None = None) -> Callable[[], Client]:
    """A factory of clients of a chat service at ``base_url``: up to ``max_concurrent`` requests at once, each tried ``TRIES`` times.

    A prompt whose request keeps failing has an empty answer, which gives no rows; an answer of status 4xx other than 429 is not tried again.
    """
    send = opener or urllib.request.urlopen

    def ask(prompt: str) -> str:
        body = {"model": config.model, "max_tokens": config.max_tokens, "temperature": config.temperature, "messages": [{"role": "user", "content": prompt}]}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(config.base_url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), headers)
        for turn in range(TRIES):
            try:
                with send(request, timeout=TIMEOUT) as answer:
                    return json.loads(answer.read())["choices"][0]["message"]["content"] or ""
            except urllib.error.HTTPError as e:
                if 400 <= e.code < 500 and e.code != 429:
                    return ""
            except (OSError, ValueError, KeyError, IndexError, TypeError):
                pass
            time.sleep(PAUSE * 2**turn)
        return ""

    def make() -> Client:
        def client(prompts: list[str]) -> list[str]:
            with ThreadPoolExecutor(max(1, config.max_concurrent)) as pool:
                return list(pool.map(ask, prompts))

        return client

    return make


def extract_json(content: str) -> str:
    """The JSON of an answer: a fenced block, else from the last line that opens a value to its balanced end, else all of it."""
    _, fence, rest = content.partition("```json\n")
    if fence:
        kept = []
        for line in rest.split("\n"):
            if line.strip() == "```":
                return "\n".join(kept).strip()
            kept.append(line)
    lines = content.split("\n")
    for i in range(len(lines) - 1, -1, -1):
        tail = "\n".join(lines[i:])
        opener = tail.lstrip()[:1]
        if opener not in ("{", "["):
            continue
        start = tail.index(opener)
        end = _balanced(tail, start)
        if end:
            return tail[start:end]
    return content.strip()


def _balanced(text: str, start: int) -> int:
    """Where the value that opens at start ends, or 0; brackets within strings do not count."""
    opener = text[start]
    closer = {"{": "}", "[": "]"}[opener]
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted and c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == opener) - (c == closer)
            if depth == 0:
                return i + 1
    return 0


def complete(prompts: DataFrame, factory: Callable[[], Client] = mock_client, size: int = 32) -> DataFrame:
    """(path, entity_name, features, description) from (path, prompt); an answer that is no JSON gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for batch in batches:
            rows = []
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                for path, answer in zip(part["path"], client(part["prompt"].tolist()), strict=True):
                    try:
                        found = json.loads(extract_json(answer))
                    except ValueError:
                        continue
                    for x in found if isinstance(found, list) else [found]:
                        if isinstance(x, dict) and "entity_name" in x:
                            rows.append((path, str(x["entity_name"]), [str(f) for f in x.get("features") or []], x.get("description")))
            yield pd.DataFrame(rows, columns=["path", "entity_name", "features", "description"])

    return prompts.select("path", "prompt").mapInPandas(run, "path string, entity_name string, features array<string>, description string")


def encode_semantics(nodes: DataFrame, prompts: DataFrame, factory: Callable[[], Client] = mock_client) -> DataFrame:
    """(node_id, features, description, feature_path): answers joined to the first node of their name in their file."""
    answers = complete(prompts, factory)
    feature_path, _ = organize_by_path(F.col("path"), F.col("entity_name"))
    first = nodes.groupBy("path", F.col("name").alias("entity_name")).agg(F.min_by("node_id", "node_seq").alias("node_id"))
    return answers.withColumn("feature_path", feature_path).join(first, ["path", "entity_name"]).select("node_id", "features", "description", "feature_path")
