"""Concurrent single requests gathered into batches, as one Spark job serves many users."""

from __future__ import annotations

import asyncio
from collections.abc import Callable, Hashable, Sequence
from concurrent.futures import Executor
from typing import Any

from pyspark.sql import SparkSession

from ..operators.base import Recommender


class MicroBatcher:
    """Calls ``process(keys) -> {key: value}`` for all keys that arrive while the last call
    runs, ``max_size`` at most; equal keys share an answer. If a batch fails and there is a
    ``fallback``, its keys are answered one by one with it."""

    def __init__(self, process: Callable[[list[Hashable]], dict], *, max_size: int = 1024, fallback: Callable[[Hashable], Any] | None = None, executor: Executor | None = None):
        self.process, self.max_size, self.fallback, self.executor = process, max_size, fallback, executor
        self.waiting: dict[Hashable, asyncio.Future] = {}
        self.task: asyncio.Task | None = None

    async def submit(self, key: Hashable) -> Any:
        loop = asyncio.get_running_loop()
        if key not in self.waiting:
            self.waiting[key] = loop.create_future()
        future = self.waiting[key]
        if self.task is None or self.task.done():
            self.task = loop.create_task(self._run())
        return await asyncio.shield(future)

    async def _run(self) -> None:
        loop = asyncio.get_running_loop()
        await asyncio.sleep(0)
        while self.waiting:
            keys = list(self.waiting)[: self.max_size]
            batch = {k: self.waiting.pop(k) for k in keys}
            try:
                found = await loop.run_in_executor(self.executor, self.process, keys)
                for k, f in batch.items():
                    f.set_result(found[k]) if k in found else f.set_exception(KeyError(k))
            except Exception as error:
                for k, f in batch.items():
                    if f.done():
                        continue
                    try:
                        if self.fallback is None:
                            raise error
                        f.set_result(self.fallback(k))
                    except Exception as e:
                        f.set_exception(e)


class AsyncRecommender:
    """``await recommend(user)``: the user's list as (item, score) pairs."""

    def __init__(self, spark: SparkSession, model: Recommender, *, k: int = 10, max_size: int = 1024, executor: Executor | None = None, fallback: Sequence = ()):
        self.spark, self.model, self.k = spark, model, k
        self.kind = model.r.schema["user_id"].dataType.simpleString()
        self.batcher = MicroBatcher(self._serve, max_size=max_size, executor=executor)
        self.fallback = list(fallback)

    def _serve(self, users: list) -> dict:
        queries = self.spark.createDataFrame([(u,) for u in users], f"user_id {self.kind}")
        out: dict = {u: [] for u in users}
        for row in self.model.recommend(queries, self.k).orderBy("qid", "rank").collect():
            out[row["user_id"]].append((row["item_id"], row["score"]))
        return {u: items or self.fallback for u, items in out.items()}

    async def recommend(self, user) -> list:
        return await self.batcher.submit(user)
