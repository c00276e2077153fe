"""User-supplied models: translators by source language, restylers by target language.

A model maps a list of texts to as many texts in the same order. It runs in Arrow batches on the
executors; a wrong number of results is an error.
"""

import json
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[str]]
HTTP_BATCH, HTTP_TIMEOUT = 32, 120


class Registry:
    """Models by language code; `aliases` lead other codes to the same model."""

    def __init__(self, aliases: dict[str, str] | None = None):
        self._aliases, self._models = dict(aliases or {}), {}

    def _code(self, lang: str) -> str:
        lang = lang.lower()
        return self._aliases.get(lang, lang)

    def register(self, lang: str, model: Model) -> None:
        self._models[self._code(lang)] = model

    def get(self, lang: str) -> Model | None:
        return self._models.get(self._code(lang))

    def available(self) -> list[str]:
        return sorted(self._models)

    def clear(self) -> None:
        self._models.clear()

    def configure(self, settings: dict, kind: type) -> None:
        """Endpoints from {lang: url or {url, batch (or batch_size), timeout, headers}}; those without a url are passed over."""
        for lang, value in (settings or {}).items():
            options = {"url": value} if isinstance(value, str) else {k: v for k, v in (value or {}).items() if v is not None}
            if options.get("url"):
                named = {"batch_size": options.get("batch", options.get("batch_size", HTTP_BATCH)), "timeout": options.get("timeout", HTTP_TIMEOUT)}
                self.register(lang, kind(self._code(lang), options["url"], headers=options.get("headers"), **named))


class HttpModel:
    """A model behind an endpoint that takes and returns JSON."""

    request_key, response_key = "lang", "texts"

    def __init__(self, lang: str, url: str, batch_size: int = HTTP_BATCH, timeout: float = HTTP_TIMEOUT, headers: dict[str, str] | None = None):
        self.lang, self.url, self.batch_size, self.timeout = lang, url, int(batch_size), float(timeout)
        self.headers = {"Content-Type": "application/json"} | {str(k): str(v) for k, v in (headers or {}).items()}

    def __call__(self, texts: list[str]) -> list[str]:
        out: list[str] = []
        for at in range(0, len(texts), self.batch_size):
            batch = texts[at : at + self.batch_size]
            body = json.dumps({self.request_key: self.lang, "texts": batch}).encode()
            request = urllib.request.Request(self.url, body, self.headers)
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                found = json.load(reply)[self.response_key]
            if len(found) != len(batch):
                raise ValueError(f"{self.url} returned {len(found)} texts for {len(batch)}")
            out += found
        return out


class HttpTranslator(HttpModel):
    request_key, response_key = "src_lang", "translations"


class HttpRestyler(HttpModel):
    request_key, response_key = "lang", "texts"


translators = Registry({"el": "grc"})
restylers = Registry()


def apply_model(texts: DataFrame, model: Model, column: str = "text", output: str = "out") -> DataFrame:
    """`texts` and the model's result of `column` as `output`, batch by batch."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        given = batch.fillna("").tolist()
        found = model(given)
        if len(found) != len(given):
            raise ValueError(f"the model returned {len(found)} texts for {len(given)}")
        return pd.Series(found, index=batch.index)

    return texts.withColumn(output, run(F.col(column)))


def restyle_beads(beads: DataFrame, model: Model, keys: Sequence[str] = ("book_id", "ch_idx", "bead_idx")) -> DataFrame:
    """Beads with restyled target texts; sources and empty targets stay as they are."""
    each = beads.select(*keys, F.posexplode("tgt").alias("pos", "text"))
    styled = apply_model(each, model, "text", "styled").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "styled"))).alias("styled"))
    joined = beads.join(styled, list(keys), "left")
    return joined.withColumn("tgt", F.when(F.col("styled").isNull(), F.col("tgt")).otherwise(F.transform("styled", lambda x: x["styled"]))).drop("styled")


def translate_segments(segments: DataFrame, model: Model) -> DataFrame:
    """Segments with `pivot`: their text in the target's language."""
    return apply_model(segments, model, "text", "pivot")


def encode_segments(segments: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], lenient: bool = False) -> DataFrame:
    """Segments with `vec`; `load` makes the encoder once in each worker. With `lenient` an encoder that can't be
    loaded or fails on a batch leaves its vectors null, so that `auto` alignment goes by lengths there."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, failed = None, False
        for batch in batches:
            try:
                encode = encode or (None if failed else load())
                found = [list(map(float, v)) for v in encode(batch.fillna("").tolist())]
            except Exception:
                if not lenient:
                    raise
                failed, found = encode is None, [None] * len(batch)
            yield pd.Series(found, index=batch.index)

    return segments.withColumn("vec", run(F.col("text")))
