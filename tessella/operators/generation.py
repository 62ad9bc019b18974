"""Text generation for many prompts; a single prompt is asked on the driver (answer.ask)."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMEOUT = 120


class HttpModel:
    """A generate endpoint that takes and returns JSON, whole or as a stream of lines."""

    def __init__(self, url: str, model: str, system: str | None = None, stream: bool = False, timeout: int = TIMEOUT):
        self.url, self.model, self.system, self.stream, self.timeout = url, model, system, stream, timeout

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "prompt": prompt, "stream": self.stream} | ({"system": self.system} if self.system else {})
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return joined(line for line in answer).strip()


def joined(lines) -> str:
    """The `response` fields of JSON lines, one after another."""
    return "".join(json.loads(x).get("response", "") for x in lines if x.strip())


def generate(prompts: DataFrame, make: Callable[[], Callable[[str], str]], column: str = "prompt") -> DataFrame:
    """prompts with answer and error. Write the result before reading it twice: calls may differ."""

    @F.pandas_udf("answer string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            rows = []
            for prompt in batch:
                try:
                    rows.append((model(prompt).strip(), None))
                except Exception as e:  # the row holds the failure
                    rows.append((f"The model failed: {e}", str(e)))
            yield pd.DataFrame(rows, columns=["answer", "error"])

    return prompts.withColumn("_r", run.asNondeterministic()(column)).select(*prompts.columns, "_r.*")
