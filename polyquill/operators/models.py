"""Model calls as an optional plug-in. Scores never need one: responses are
input tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Client = Callable[[str, str], str]


def call_models(prompts: DataFrame, make_client: Callable[[], Client], attempts: int = 10, pause: float = 10.0) -> DataFrame:
    """Adds `response` by a client made once per task: client(model, prompt).
    A call that fails all its attempts gives null; one row never fails the job."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields) + ", response string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def ask(model: str, prompt: str) -> str | None:
            for k in range(attempts):
                try:
                    return client(model, prompt)
                except Exception:
                    if k + 1 < attempts:
                        time.sleep(pause)
            return None

        for batch in batches:
            yield batch.assign(response=[ask(m, p) for m, p in zip(batch["model"], batch["prompt"], strict=True)])

    return prompts.mapInPandas(run, schema)
