"""The tokenizer and the TF-IDF analyzer as ``pyspark.ml`` transformers.

They hold their settings as ``Params``, so a ``PipelineModel`` from text to
prediction can be saved, loaded and applied to a batch or a stream.
"""

from __future__ import annotations

import dataclasses

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from ..functions.features import tfidf_analyze
from ..functions.tokenizer import DEFAULT, TokenizerConfig, tokenize


class TfidfAnalyzer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Text -> lower-cased terms of two or more word characters (null: none)."""

    def __init__(self, *, inputCol: str = "text", outputCol: str = "tokens"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), tfidf_analyze(self.getInputCol()))


class MessageTokenizer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Message -> tokens (see ``functions.tokenizer``).

    ``settings``: the settings that differ from the defaults, by name, as
    ``TokenizerConfig.update`` takes them; unknown names raise.  ``strict``:
    null text raises instead of giving no tokens.
    """

    settings = Param(Params._dummy(), "settings", "tokenizer settings that differ from the defaults")
    strict = Param(Params._dummy(), "strict", "whether null text raises", typeConverter=TypeConverters.toBoolean)

    def __init__(self, *, inputCol: str = "text", outputCol: str = "tokens", strict: bool = False, **settings):
        super().__init__()
        DEFAULT.update(**settings)
        self._set(inputCol=inputCol, outputCol=outputCol, strict=strict, settings=settings)

    def config(self) -> TokenizerConfig:
        given = self.getOrDefault(self.settings)
        lists = {f.name for f in dataclasses.fields(TokenizerConfig) if f.name in ("emoticons", "stopwords", "emojis", "domains")}
        return DEFAULT.update(**{k: tuple(v) if k in lists else v for k, v in given.items()})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        tokens = tokenize(self.getInputCol(), self.config(), self.getOrDefault(self.strict))
        return dataset.withColumn(self.getOutputCol(), tokens)
