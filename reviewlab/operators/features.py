"""Feature encoding for the learners.

Categories become codes with Spark ML's ``StringIndexer`` (sorted levels, a
null or unseen value gets its own code), ordered factors their level
position, numbers stay numbers. ``feature_matrix`` assembles them into an ML
vector column (categorical codes keep their nominal metadata, so Spark's
trees split them as categories, not as numbers).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def split_kinds(df: DataFrame, features: list[str], categorical: list[str] | None = None):
    """(numeric, categorical) feature lists; strings are categorical unless
    listed otherwise."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    if categorical is None:
        categorical = [c for c in features if not isinstance(types[c], NUMERIC)]
    numeric = [c for c in features if c not in categorical]
    return numeric, categorical


@dataclass
class FeatureSpec:
    numeric: list[str]
    categorical: list[str]
    model: PipelineModel
    levels: dict = field(default_factory=dict)   # categorical column -> level list
    ordered: dict = field(default_factory=dict)  # ordered column -> stated level list

    @property
    def names(self) -> list[str]:
        return self.categorical + list(self.ordered) + self.numeric


def fit_features(df: DataFrame, features: list[str], categorical: list[str] | None = None,
                 one_hot: bool = False, out: str = "features",
                 ordered: dict[str, list] | None = None) -> FeatureSpec:
    """Fit the encoding on ``df``, whose levels are learnt: pass all rows to
    learn them from all, or the training part only. Columns of ``ordered`` are
    the position of the value in the stated list (-1 for a null or a value
    that isn't there), a number that trees split by order."""
    ordered = ordered or {}
    numeric, cats = split_kinds(df, [c for c in features if c not in ordered], categorical)
    stages = [StringIndexer(inputCol=f"__c_{c}", outputCol=f"{c}__i", handleInvalid="keep",
                            stringOrderType="alphabetAsc") for c in cats]
    cols = [f"{c}__i" for c in cats]
    if one_hot and cats:
        stages.append(OneHotEncoder(inputCols=cols, outputCols=[f"{c}__oh" for c in cats],
                                    dropLast=False, handleInvalid="keep"))
        cols = [f"{c}__oh" for c in cats]
    stages.append(VectorAssembler(inputCols=cols + [f"__o_{c}" for c in ordered] + numeric, outputCol=out,
                                  handleInvalid="keep"))
    model = Pipeline(stages=stages).fit(_encodable(df, cats, numeric, [], ordered))
    levels = {c: list(m.labelsArray[0]) for c, m in zip(cats, model.stages[:len(cats)])}
    return FeatureSpec(numeric, cats, model, levels, ordered)


def _position(col: str, levels: list):
    places = F.array(*[F.lit(str(v)) for v in levels])
    return (F.coalesce(F.array_position(places, F.col(col).cast("string")), F.lit(0)) - 1).cast("double")


def _encodable(df: DataFrame, cats: list[str], numeric: list[str], keep: list[str],
               ordered: dict[str, list]) -> DataFrame:
    return df.select(*keep,
                     *[F.col(c).cast("string").alias(f"__c_{c}") for c in cats],
                     *[_position(c, v).alias(f"__o_{c}") for c, v in ordered.items()],
                     *[F.col(c) for c in numeric if c not in keep])


def feature_matrix(df: DataFrame, spec: FeatureSpec, keep: list[str] | None = None) -> DataFrame:
    """Encode ``df`` with a fitted spec: ``keep`` columns + the vector."""
    keep = list(keep or [])
    out = spec.model.transform(_encodable(df, spec.categorical, spec.numeric, keep, spec.ordered))
    drop = [c for c in out.columns if c.startswith(("__c_", "__o_")) or c.endswith("__i") or c.endswith("__oh")]
    drop += [c for c in spec.numeric if c not in keep]
    return out.drop(*drop)
