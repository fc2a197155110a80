"""The one Python boundary: a translation provider called in batches, with retries and a deadline, one session a partition."""

from __future__ import annotations

import importlib
import queue
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as T

RESPONSE = "struct<translations:array<struct<id:int,text:string>>>"


class Translator(Protocol):
    """Made once in each partition; ``translate`` answers in the order of the texts.

    Titles go to ``translate_title`` and single doubtful texts to ``translate_unit`` where a provider has them.
    """

    def translate(self, texts: list[str]) -> list[str]: ...


class OfflineTranslator:
    """Letter for letter; keeps length, capitals and marks, so every check can be exercised without a network."""

    table = str.maketrans(V.LATIN, V.OFFLINE)

    def translate(self, texts: list[str]) -> list[str]:
        return [t.translate(self.table) for t in texts]


class LimitedTranslator(OfflineTranslator):
    """As providers with a limit on a text's length: a longer one fails its call."""

    limit = 600

    def translate(self, texts: list[str]) -> list[str]:
        for t in texts:
            if len(t) > self.limit:
                raise ValueError(f"{len(t)} characters are over the limit of {self.limit}")
        return super().translate(texts)


#: The option that names the provider, and what it may name besides "module:Class".
OPTION = "spark.folioflow.provider"
PROVIDERS: dict[str, type] = {"offline": OfflineTranslator, "limited": LimitedTranslator}


def named(spark: SparkSession, name: str | None = None) -> type:
    """The provider of this name, or of the session's option, or the offline one."""
    name = (name or spark.conf.get(OPTION, "offline")).strip()
    if name.lower() in PROVIDERS:
        return PROVIDERS[name.lower()]
    module, colon, kind = name.partition(":")
    if not colon:
        raise ValueError(f"no provider is named {name}; known: {', '.join(sorted(PROVIDERS))}, or module:Class")
    return getattr(importlib.import_module(module), kind)


def _method(provider: Translator, kind: str) -> Callable[[list[str]], list[str]]:
    return getattr(provider, {"title": "translate_title", "unit": "translate_unit"}.get(kind, "translate"), provider.translate)


def offline(c: Column) -> Column:
    """The offline provider as a native expression."""
    return F.translate(c, V.LATIN, V.OFFLINE)


def prompt(items: Column) -> Column:
    """JSON of [{id, text}, ...]; items: array<struct<unit_index, text>>."""
    return F.to_json(F.transform(items, lambda i: F.struct(i["unit_index"].alias("id"), i["text"].alias("text"))))


def _answers(c: Column) -> Column:
    """array<struct<id, text>> of a model's JSON answer; of answers that repeat an id the last, none without an id.

    The JSON is parsed once, and the answers are sorted by id, so the cost doesn't grow with the square of their number.
    """

    def parsed(s: Column) -> Column:
        fence = F.length(F.regexp_extract(s, r"^```(?:json)?\s*", 0))
        end = F.length(s) - F.when(s.endswith("```") & (F.length(s) >= fence + 3), 3).otherwise(0)
        return T.bind(F.rtrim(F.substring(s, fence + 1, end - fence), F.lit(" \t\n\x0b\f\r")), lambda b: F.from_json(F.when(b.startswith("["), F.concat(F.lit('{"translations":'), b, F.lit("}"))).otherwise(b), RESPONSE)["translations"])

    def last_of_each(items: Column) -> Column:
        places = F.array_sort(F.filter(F.transform(items, lambda x, i: F.struct(x["id"].alias("id"), i.alias("at"))), lambda x: x["id"].isNotNull()))
        last = T.bind(places, lambda p: F.filter(p, lambda x, i: ~F.coalesce(F.get(p, i + 1)["id"] == x["id"], F.lit(False))))
        return F.transform(F.array_sort(F.transform(last, lambda x: x["at"])), lambda i: F.get(items, i))

    return T.bind(T.bind(T.strip(c), parsed), last_of_each)


def parse_response(c: Column) -> Column:
    """map<int, string> of a model's JSON answer: an object with ``translations`` or an array, in a code fence or not.

    Of answers that repeat an id the last counts; null where the JSON doesn't parse.  Texts are cleaned, but for entities,
    which ``response_rows`` decodes.
    """
    return F.map_from_entries(F.transform(_answers(c), lambda x: F.struct(x["id"], T.clean_translation(x["text"], entities=False))))


def response_rows(rows: DataFrame, response: str) -> DataFrame:
    """The other columns with (id, text) of each answer in the column ``response``: cleaned whole, HTML entities decoded.

    A response that doesn't parse gives no rows.
    """
    kept = [c for c in rows.columns if c != response]
    each = rows.select(*kept, F.explode(_answers(F.col(response))).alias("answer"))
    return each.select(*kept, F.col("answer.id").alias("id"), T.clean_translation(F.col("answer.text")).alias("text"))


def _calls(asked: queue.SimpleQueue, answered: queue.SimpleQueue) -> None:
    while (x := asked.get()) is not None:
        call, texts = x
        try:
            answered.put((call(texts), None))
        except Exception as e:  # raised again by who waits
            answered.put((None, e))
        del x, call, texts


class _Caller:
    """A thread that makes one call after the other; it ends with this object, or after the call that it hangs in."""

    def __init__(self) -> None:
        self.asked, self.answered = queue.SimpleQueue(), queue.SimpleQueue()
        threading.Thread(target=_calls, args=(self.asked, self.answered), daemon=True).start()

    def __del__(self) -> None:
        self.asked.put(None)


_own = threading.local()


def within(seconds: float | None, call: Callable, texts: list[str]) -> list[str]:
    """The call's answer, or TimeoutError after so many seconds; its thread is left to end alone, else the next call takes it."""
    if seconds is None:
        return call(texts)
    caller, _own.caller = getattr(_own, "caller", None) or _Caller(), None
    caller.asked.put((call, texts))
    try:
        got, error = caller.answered.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds:g} seconds") from None
    _own.caller = caller
    if error is not None:
        raise error
    return got


def with_retries(call: Callable, texts: list[str], attempts: int = V.ATTEMPTS, sleep: float = V.RETRY_SLEEP_SECONDS, deadline: float | None = None) -> list[str]:
    for n in range(attempts):
        try:
            return within(deadline, call, texts)
        except Exception:
            if n + 1 == attempts:
                raise
            time.sleep(sleep)
    raise AssertionError("no attempts")


def translate(batches: DataFrame, make: type | None = None, threads: int = 4, partitions: int | None = None, sleep: float = V.RETRY_SLEEP_SECONDS, kind: str = "batch", deadline: float | None = V.TIMEOUT_SECONDS) -> DataFrame:
    """(doc_id, unit_index, translated, error) for batches (doc_id, batch_id, unit_index, text), with their ``key`` if they have one.

    Calls go out from ``partitions`` tasks with ``threads`` threads each, and fail after ``deadline`` seconds.  A batch that
    fails after all attempts becomes rows with an error, so a document fails alone.
    """
    make = make or OfflineTranslator
    keys = [c for c in ("key",) if c in batches.columns]

    def run(chunks: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        method = _method(provider, kind)

        def call(rows: list[tuple]) -> list[tuple]:
            try:
                got = with_retries(method, [r[3] for r in rows], sleep=sleep, deadline=deadline)
                return [(r[0], r[2], g, None, *r[4:]) for r, g in zip(rows, got, strict=False)]
            except Exception as e:  # the row says so
                return [(r[0], r[2], None, f"{type(e).__name__}: {e}", *r[4:]) for r in rows]

        with ThreadPoolExecutor(threads) as pool:
            for chunk in chunks:
                groups: dict[tuple, list] = {}
                for r in zip(*(c.to_pylist() for c in chunk.columns), strict=True):
                    groups.setdefault(r[:2], []).append(r)
                out = [x for rows in pool.map(call, groups.values()) for x in rows]
                names = ["doc_id", "unit_index", "translated", "error", *keys]
                cols = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32()] + [pa.string()] * (2 + len(keys)), strict=True)], names)

    rows = batches.select("doc_id", "batch_id", F.col("unit_index").cast("int").alias("unit_index"), "text", *keys)
    rows = rows.repartition(partitions, "doc_id", "batch_id") if partitions else rows
    return rows.mapInArrow(run, "doc_id long, unit_index int, translated string, error string" + "".join(f", {k} string" for k in keys))
