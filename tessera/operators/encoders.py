"""Categorical encoders. Null is the category `nan`. State tables have one row per category and column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import InputValidationError
from tessera.operators.base import Operator, add, chosen, key, lookup, number, scalars, string_columns
from tessera.operators.order import medians


def per_category(df: DataFrame, cols: list[str], aggs: dict[str, Column], **inputs: Column) -> DataFrame:
    """One groupBy for all columns: (c, v, aggregates of the inputs)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), key(c).alias("v")) for c in cols])).alias("x")
    rows = df.select(pairs, *[e.alias(n) for n, e in inputs.items()]).select("x.*", *inputs)
    return rows.groupBy("c", "v").agg(*[e.alias(n) for n, e in aggs.items()])


def apply_lookups(df: DataFrame, table: DataFrame, cols: list[str], made, rows: int) -> DataFrame:
    """For each column, join its part of the table; made(c): {table column: (output, default)}."""
    for c in cols:
        names = made(c)
        part = table.filter(F.col("c") == c).select("v", *[F.col(k).alias(out) for k, (out, _) in names.items()])
        df = lookup(df, part, {"v": key(c)}, {out: d for out, d in names.values()}, rows, null_safe=False)
    return df


class _Counted(Operator):
    """Encoders with a state table; its size decides between broadcast and shuffle joins."""

    def learn(self, df):
        cols = chosen(df, self.cols, string_columns(df, [getattr(self, "label_col", None)]))
        state, table = self.table(df, cols)
        return {"cols": cols, "rows": table.count(), **state}, {"categories": table}


class RareCategoryGrouper(_Counted):
    """Categories with a share over min_freq stay; others, and unseen ones, become Other."""

    defaults = {"min_freq": 0.01, "preserve_sentinel": True, "sentinel_value": "__MISSING__", "cols": None, "other": "Other"}

    def table(self, df, cols):
        n = df.count()
        t = per_category(df, cols, {"n": F.count(F.lit(1))}).filter((F.col("n") > self.min_freq * n) & (F.col("v") != "nan"))
        return {}, t.select("c", "v", F.col("v").alias("kept"))

    def apply(self, df, state, tables):
        out = apply_lookups(df, tables["categories"], state["cols"], lambda c: {"kept": (f"__kept_{c}", None)}, state["rows"])
        made = {}
        for c in state["cols"]:
            x = F.col(c).cast("string")
            keep = F.col(f"__kept_{c}").isNotNull() | (x == self.sentinel_value if self.preserve_sentinel else F.lit(False))
            made[c] = F.when(x.isNull(), None).when(keep, x).otherwise(F.lit(self.other))
        return add(out, made).drop(*[f"__kept_{c}" for c in state["cols"]])


def md5_bucket(text: Column, n: int) -> Column:
    """int(md5(text), 16) mod n, folded over four 32-bit parts."""
    h = F.md5(text)
    out = F.lit(0).cast("long")
    for k in range(4):
        part = F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")
        out = F.pmod(out * F.lit(2**32 % n) + part, F.lit(n))
    return out


class HashingEncoder(Operator):
    """Counts of hash buckets, shared by all columns: a sparse map, or one column per bucket."""

    defaults = {"n_features": 256, "seed": 42, "cols": None, "output": "columns"}

    def learn(self, df):
        return {"cols": chosen(df, self.cols, string_columns(df))}, {}

    def buckets(self, cols) -> Column:
        return F.array(*[md5_bucket(F.concat(F.lit(f"{c}="), key(c), F.lit(f":{self.seed}")), self.n_features) for c in cols])

    def apply(self, df, state, tables):
        if self.output != "sparse":
            at = {f"__b{k}": md5_bucket(F.concat(F.lit(f"{c}="), key(c), F.lit(f":{self.seed}")), self.n_features) for k, c in enumerate(state["cols"])}
            hits = lambda i: sum(((F.col(b) == i).cast("double") for b in at), F.lit(0.0))
            return add(df.withColumns(at), {f"hash_{i}": hits(i) for i in range(self.n_features)}).drop(*at)
        out = df.withColumn("__b", self.buckets(state["cols"]))
        counts = F.transform(F.array_sort(F.array_distinct("__b")), lambda b: F.struct(b.cast("int").alias("i"), F.size(F.filter("__b", lambda x: x == b)).cast("double").alias("n")))
        return out.withColumn("hash_features", F.map_from_entries(counts)).drop("__b")


def binary_target(df: DataFrame, label: str, positive_class=None, task: str | None = None) -> tuple[Column, str]:
    """The target as a number, and the task. Classes become 1 for the positive one: 1 if all are 0 or 1, else the most frequent (the least of several)."""
    y = F.col(label)
    if task is None:
        task = "classification" if df.select(label).distinct().limit(21).count() <= 20 else "regression"
    if task != "classification":
        return number(label), task
    if positive_class is None:
        counts = df.groupBy(y.cast("string").alias("k")).count().filter("k IS NOT NULL")
        other = counts.filter(~F.col("k").isin("0", "1", "0.0", "1.0", "true", "false")).limit(1).count()
        if not other:
            return F.when(y.isNotNull(), y.cast("double")), task
        positive_class = counts.agg(F.min_by("k", F.struct(-F.col("count"), F.col("k")))).first()[0]
    return F.when(y.isNotNull(), (y.cast("string") == str(positive_class)).cast("double")), task


class _Target(_Counted):
    """Encoders by means of the target, which must not be an input of transform."""

    defaults = {"cols": None, "label_col": "y", "smoothing": 0.3, "task": None, "positive_class": None, "prior_strategy": "global_mean"}

    def check(self):
        if self.label_col in (self.cols or []):
            raise InputValidationError("the label is no input", label=self.label_col)

    def sums(self, df, cols):
        y, task = binary_target(df, self.label_col, self.positive_class, self.task)
        d = df.withColumn("__y", y)
        prior = medians(d, {"p": F.col("__y").cast("double")})["p"] if self.prior_strategy == "median" else scalars(d, {"p": F.avg("__y")})["p"]
        return {"prior": prior or 0.0}, per_category(d, cols, {"s": F.sum("y"), "n": F.count("y")}, y=F.col("__y"))

    def encoded(self, s: Column, n: Column, prior) -> Column:
        return (s + self.smoothing * prior) / (n + self.smoothing)

    def table(self, df, cols):
        state, t = self.sums(df, cols)
        return state, t.select("c", "v", self.encoded(F.coalesce("s", F.lit(0.0)), F.col("n"), state["prior"]).alias("te"), "s", "n")

    def apply(self, df, state, tables):
        return apply_lookups(df, tables["categories"], state["cols"], lambda c: {"te": (f"{c}_te", state["prior"])}, state["rows"])


class KFoldTargetEncoder(_Target):
    """Smoothed category means from all rows; `reference_sums` scales sums and counts by k - 1, as sums over training folds do."""

    defaults = {**_Target.defaults, "n_splits": 5, "noise_std": 0.0, "random_state": 42, "reference_sums": False}

    def encoded(self, s, n, prior):
        k = self.n_splits - 1 if self.reference_sums else 1
        return (k * s + self.smoothing * prior) / (k * n + self.smoothing)

    def apply(self, df, state, tables):
        out = super().apply(df, state, tables)
        return add(out, {f"{c}_te": F.col(f"{c}_te") + F.randn(self.random_state) * self.noise_std for c in state["cols"]}) if self.noise_std else out


class LeaveOneOutTargetEncoder(_Target):
    """Means that leave the row itself out (fit_transform), or (S + m p) / (C + m) with the prior for single rows (transform, mode reference)."""

    defaults = {**_Target.defaults, "mode": "true_loo"}

    def encoded(self, s, n, prior):
        return F.when(n > 1, super().encoded(s, n, prior)).otherwise(prior)

    def fit_transform(self, df):
        model = self.fit(df)
        if self.mode == "reference":
            return model.transform(df)
        state = model.state
        y, _ = binary_target(df, self.label_col, self.positive_class, self.task)
        out = apply_lookups(df.withColumn("__y", y), model.tables["categories"], state["cols"], lambda c: {"s": (f"__s_{c}", 0.0), "n": (f"__n_{c}", 0)}, state["rows"])
        own = F.coalesce("__y", F.lit(0.0))
        had = F.col("__y").isNotNull().cast("int")
        made = {f"{c}_te": (F.col(f"__s_{c}") - own + self.smoothing * state["prior"]) / (F.col(f"__n_{c}") - had + self.smoothing) for c in state["cols"]}
        return add(out, made).drop("__y", *[f"__{k}_{c}" for k in "sn" for c in state["cols"]])


class WoEEncoder(_Counted):
    """Weight of evidence per category, and information value per column."""

    defaults = {"cols": None, "label_col": "y", "smoothing": 0.5, "random_state": 42, "positive_class": None}

    def table(self, df, cols):
        y, _ = binary_target(df, self.label_col, self.positive_class, "classification")
        t = per_category(df.withColumn("__y", y), cols, {"p": F.coalesce(F.sum("y"), F.lit(0.0)), "n": F.count("y") - F.coalesce(F.sum("y"), F.lit(0.0))}, y=F.col("__y"))
        totals = t.groupBy("c").agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"), F.count(F.lit(1)).alias("k"))
        t = t.join(F.broadcast(totals), "c")  # one row per column
        s = self.smoothing
        pos, neg = (F.col("p") + s) / (F.col("tp") + s * F.col("k")), (F.col("n") + s) / (F.col("tn") + s * F.col("k"))
        t = t.select("c", "v", F.ln(pos / neg).alias("woe"), ((pos - neg) * F.ln(pos / neg)).alias("iv"))
        return {"iv": {r.c: r.iv for r in t.groupBy("c").agg(F.sum("iv").alias("iv")).collect()}}, t

    def apply(self, df, state, tables):
        return apply_lookups(df, tables["categories"], state["cols"], lambda c: {"woe": (f"{c}_woe", 0.0)}, state["rows"])


class OrdinalEncoder(_Counted):
    """Given order, else sorted values; unknown and null get unknown_value."""

    defaults = {"cols": None, "ordinal_maps": None, "handle_unknown": "use_encoded_value", "unknown_value": -1.0}

    def table(self, df, cols):
        t = per_category(df.select(*cols), cols, {"n": F.count(F.lit(1))}).filter("v != 'nan'")
        t = t.withColumn("code", (F.row_number().over(Window.partitionBy("c").orderBy("v")) - 1).cast("double")).select("c", "v", "code")
        given = [(c, str(v), float(i)) for c, values in (self.ordinal_maps or {}).items() if c in cols for i, v in enumerate(values)]
        if given:
            t = t.filter(~F.col("c").isin(list(self.ordinal_maps))).unionByName(df.sparkSession.createDataFrame(given, "c string, v string, code double"))
        return {}, t

    def apply(self, df, state, tables):
        return apply_lookups(df, tables["categories"], state["cols"], lambda c: {"code": (f"{c}_ord", float(self.unknown_value))}, state["rows"])


class OneHotEncoder(Operator):
    """0/1 columns of frequent categories, one for all infrequent ones together; a binary column keeps its second value only."""

    defaults = {"cols": None, "min_frequency": 0.01, "handle_unknown": "infrequent_if_exist", "max_categories": 1000}

    def learn(self, df):
        cols = chosen(df, self.cols, string_columns(df))
        n = df.count()
        t = per_category(df, cols, {"n": F.count(F.lit(1))})
        frequent = t.filter(F.col("n") >= self.min_frequency * n)  # at most 1 / min_frequency rows a column
        if self.min_frequency <= 0:
            frequent = frequent.limit(self.max_categories * len(cols) + 1)
        kept: dict[str, list[str]] = {c: [] for c in cols}
        for r in frequent.collect():
            kept[r.c].append(r.v)
        if any(len(v) > self.max_categories for v in kept.values()):
            raise InputValidationError("too many categories for columns of their own", limit=self.max_categories)
        rare = {r.c for r in t.filter(F.col("n") < self.min_frequency * n).select("c").distinct().collect()}
        return {"kept": {c: sorted(v) for c, v in kept.items()}, "rare": sorted(rare)}, {}

    def apply(self, df, state, tables):
        made = {}
        for c, values in state["kept"].items():
            binary = len(values) == 2 and c not in state["rare"]
            for v in values[1:] if binary else values:
                made[f"{c}_{v}"] = (key(c) == v).cast("int")
            if c in state["rare"]:
                made[f"{c}_infrequent"] = (~key(c).isin(values)).cast("int") if values else F.lit(1)
        return add(df, made)


def make_ohe(min_frequency: float = 0.01, handle_unknown: str = "infrequent_if_exist") -> OneHotEncoder:
    return OneHotEncoder(min_frequency=min_frequency, handle_unknown=handle_unknown)


class OutOfFoldTargetEncoder(_Target):
    """Training rows get means over the other folds, from totals less the fold's own sums: two aggregates, no loop over folds.

    The fold of a row is its fold_col mod n_splits (an integer), or a hash of the row id and seed. A custom splitter is a
    fold column made beforehand; cv 'time' orders by the row id, so folds are ranges and only earlier folds count.
    """

    defaults = {**_Target.defaults, "smoothing": 20.0, "n_splits": 5, "cv": "kfold", "row_id": None, "fold_col": None, "random_state": 42}

    def fold(self) -> Column:
        if self.fold_col:
            return F.pmod(F.col(self.fold_col).cast("long"), F.lit(self.n_splits))
        return F.pmod(F.xxhash64(self.row_id, F.lit(self.random_state)), F.lit(self.n_splits))

    def fit_transform(self, df):
        model = self.fit(df)
        state, cols = model.state, model.state["cols"]
        y, _ = binary_target(df, self.label_col, self.positive_class, self.task)
        d = df.withColumns({"__y": y, "__f": self.fold()})
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), key(c).alias("v")) for c in cols])).alias("x")
        own = d.select(pairs, F.col("__f").alias("f"), F.col("__y").alias("y")).groupBy("x", "f").agg(F.sum("y").alias("s"), F.count("y").alias("n")).select("x.*", "f", "s", "n")
        if self.cv == "time":
            w = Window.partitionBy("c", "v").orderBy("f").rowsBetween(Window.unboundedPreceding, -1)  # over folds of a category
            rest = own.select("c", "v", "f", F.coalesce(F.sum("s").over(w), F.lit(0.0)).alias("s"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n"))
        else:
            t = model.tables["categories"].select("c", "v", F.col("s").alias("ts"), F.col("n").alias("tn"))
            rest = own.join(t, ["c", "v"]).select("c", "v", "f", (F.coalesce("ts", F.lit(0.0)) - F.coalesce("s", F.lit(0.0))).alias("s"), (F.col("tn") - F.col("n")).alias("n"))
        rest = rest.withColumn("te", F.when(F.col("n") > 0, self.encoded(F.col("s"), F.col("n"), state["prior"])).otherwise(state["prior"]))
        out = d
        for c in cols:
            part = rest.filter(F.col("c") == c).select("v", "f", F.col("te").alias(f"{c}_te"))
            out = lookup(out, part, {"v": key(c), "f": F.col("__f")}, {f"{c}_te": state["prior"]}, state["rows"] * self.n_splits, null_safe=False)
        return out.drop("__y", "__f")


class FrequencyEncoder(_Counted):
    defaults = {"cols": None, "unseen_value": 0.0}

    def table(self, df, cols):
        n = df.count()
        return {}, per_category(df, cols, {"n": F.count(F.lit(1))}).select("c", "v", (F.col("n") / max(n, 1)).alias("x"))

    def apply(self, df, state, tables):
        return apply_lookups(df, tables["categories"], state["cols"], lambda c: {"x": (f"{c}_freq", float(self.unseen_value))}, state["rows"])


class CountEncoder(_Counted):
    defaults = {"cols": None, "unseen_value": 0.0, "normalize": False}

    def table(self, df, cols):
        n = df.count() if self.normalize else 1
        return {}, per_category(df, cols, {"n": F.count(F.lit(1))}).select("c", "v", (F.col("n") / max(n, 1)).alias("x"))

    def apply(self, df, state, tables):
        return apply_lookups(df, tables["categories"], state["cols"], lambda c: {"x": (f"{c}_count", float(self.unseen_value))}, state["rows"])


class CatBoostEncoder(_Target):
    """Ordered target statistics: each training row sees earlier rows of its category only, in the order of order_col or of a hash.

    A category's rows are sorted in one window; with a category of a third of all rows that is one task. `buckets` over 1
    cuts the order into ranges, sums them first, and sorts within a range only.
    """

    defaults = {**_Target.defaults, "smoothing": 10.0, "order_col": None, "row_id": None, "random_state": 42, "buckets": 1}

    def fit_transform(self, df):
        model = self.fit(df)
        state = model.state
        y, _ = binary_target(df, self.label_col, self.positive_class, self.task)
        ids = [self.row_id] if self.row_id else []
        by = [F.col(self.order_col), *[F.col(x) for x in ids]] if self.order_col else [F.xxhash64(*ids, F.lit(self.random_state)), *[F.col(x) for x in ids]]
        d = df.withColumn("__y", y)
        if self.buckets > 1:
            cuts = [x for x in (d.select(by[0].cast("double").alias("o")).approxQuantile("o", [i / self.buckets for i in range(1, self.buckets)], 0.001))]
            bucket = F.lit(0)
            for x in cuts:
                bucket = bucket + (by[0].cast("double") > x).cast("int")
        else:
            bucket = F.lit(0)
        d = d.withColumn("__b", bucket)
        for c in state["cols"]:
            w = Window.partitionBy(key(c), F.col("__b")).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
            s, n = F.coalesce(F.sum("__y").over(w), F.lit(0.0)), F.coalesce(F.count("__y").over(w), F.lit(0))
            if self.buckets > 1:
                before = Window.partitionBy("v").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # over buckets
                sums = d.groupBy(key(c).alias("v"), "__b").agg(F.sum("__y").alias("s"), F.count("__y").alias("n"))
                sums = sums.select("v", "__b", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("__s0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n0"))
                d = lookup(d, sums, {"v": key(c), "__b": F.col("__b")}, {"__s0": 0.0, "__n0": 0}, null_safe=False)
                d = d.withColumns({"__s": s, "__n": n}).withColumn(f"{c}_te", self.encoded(F.col("__s") + F.col("__s0"), F.col("__n") + F.col("__n0"), state["prior"])).drop("__s", "__n", "__s0", "__n0")
            else:
                d = d.withColumn(f"{c}_te", self.encoded(s, n, state["prior"]))
        return d.drop("__y", "__b")


class BinaryEncoder(_Counted):
    """Bits of a category's number in sorted order, largest first; unknown ones have none set."""

    defaults = {"cols": None, "handle_unknown": "value", "unknown_value": -1}

    def table(self, df, cols):
        t = per_category(df, cols, {"n": F.count(F.lit(1))})
        t = t.withColumn("code", (F.row_number().over(Window.partitionBy("c").orderBy("v")) - 1).cast("int")).select("c", "v", "code")
        k = {r.c: r.k for r in t.groupBy("c").agg(F.count(F.lit(1)).alias("k")).collect()}
        return {"bits": {c: max(1, math.ceil(math.log2(max(k.get(c, 0), 2)))) for c in cols}}, t

    def apply(self, df, state, tables):
        out = apply_lookups(df, tables["categories"], state["cols"], lambda c: {"code": (f"__code_{c}", 0)}, state["rows"])
        made = {f"binary_{c}_{i}": F.expr(f"shiftright(`__code_{c}`, {b - 1 - i}) & 1") for c, b in state["bits"].items() for i in range(b)}
        return add(out, made).drop(*[f"__code_{c}" for c in state["cols"]])


class EntityEmbeddingsEncoder(_Counted):
    """A vector per category: the leading components of its co-occurrence with the binned target and other columns.

    Stands in for a trained neural embedding behind the same interface: Word2Vec over each row's tokens.
    """

    defaults = {"cols": None, "embedding_dim": None, "random_state": 42, "max_iter": 1}

    def table(self, df, cols):
        from pyspark.ml.feature import Word2Vec

        k = scalars(df, {c: F.count_distinct(key(c)) for c in cols})
        dim = self.embedding_dim or max(2, min(50, max(k.values(), default=2) // 2))
        rows = df.select(F.array(*[F.concat(F.lit(f"{c}="), key(c)) for c in cols]).alias("tokens"))
        model = Word2Vec(vectorSize=dim, minCount=1, seed=self.random_state, maxIter=self.max_iter, inputCol="tokens", outputCol="o").fit(rows)
        from pyspark.ml.functions import vector_to_array

        t = model.getVectors().select(F.substring_index("word", "=", 1).alias("c"), F.expr("substring(word, instr(word, '=') + 1)").alias("v"), vector_to_array("vector").alias("e"))
        return {"dim": dim}, t

    def apply(self, df, state, tables):
        out = apply_lookups(df, tables["categories"], state["cols"], lambda c: {"e": (f"__e_{c}", None)}, state["rows"])
        made = {f"emb_{c}_{i}": F.coalesce(F.get(F.col(f"__e_{c}"), F.lit(i)), F.lit(0.0)) for c in state["cols"] for i in range(state["dim"])}
        return add(out, made).drop(*[f"__e_{c}" for c in state["cols"]])
