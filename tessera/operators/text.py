"""Text features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import ConfigurationError, InputValidationError, MissingBackendError
from tessera.operators.base import Operator, add, chosen, scalars, string_columns
from tessera.sources.staging import stage

#: A short English stop-word list (fixed values).
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing "
    "down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not "
    "now of off on once only or other our out over own same she should so some such than that the their them then there these they this those "
    "through to too under until up very was we were what when where which while who whom why will with you your"
).split()
SPLIT = r"\s+"


def text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def tokens(x: Column, separator: str = SPLIT) -> Column:
    return F.array_remove(F.split(x, separator), "")


def count_of(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


class TextStatisticsExtractor(Operator):
    defaults = {"columns": None, "extract_linguistic": False, "stopwords": None}

    def apply(self, df, state, tables):
        for c in chosen(df, self.columns, string_columns(df)):
            df = df.withColumn("__w", tokens(text(c)))
            x, w = text(c), F.col("__w")
            n = F.size(w)
            unique = F.size(F.array_distinct(F.transform(w, F.lower)))
            letters = F.length(F.array_join(w, ""))
            made = {
                "char_count": F.length(x),
                "word_count": n,
                "sentence_count": count_of(x, r"[.!?]+"),
                "avg_word_length": F.coalesce(F.try_divide(letters, n), F.lit(0.0)),
                "unique_word_count": unique,
                "unique_word_ratio": F.coalesce(F.try_divide(unique, n), F.lit(0.0)),
            }
            if self.extract_linguistic:
                share = lambda e: F.coalesce(F.try_divide(e, F.length(x)), F.lit(0.0))
                upper, digit = count_of(x, "[A-Z]"), count_of(x, r"\d")
                stop = F.array(*[F.lit(s) for s in (self.stopwords or STOPWORDS)])
                made |= {
                    "stopword_count": F.size(F.filter(w, lambda t: F.array_contains(stop, F.lower(t)))),
                    "punctuation_count": count_of(x, r"[!-/:-@\[-`{-~]"),
                    "uppercase_count": upper,
                    "uppercase_ratio": share(upper),
                    "digit_count": digit,
                    "digit_ratio": share(digit),
                    "special_char_count": count_of(x, r"[^a-zA-Z0-9\s]"),
                    "whitespace_count": count_of(x, r"\s"),
                }
            df = add(df, {f"{c}_{k}": e for k, e in made.items()}).drop("__w")
        return df


class NLPTextStatistics(Operator):
    defaults = {"text_col": None, "include_readability": True, "include_pos": False, "pos_tagger": None}

    def apply(self, df, state, tables):
        c, x = self.text_col, text(self.text_col)
        df = df.withColumn("__w", tokens(x))
        n = F.size("__w")
        sentences = F.size(F.filter(F.split(x, r"[.!?]+"), lambda s: F.trim(s) != ""))
        share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
        made = {
            "char_count": F.length(x),
            "word_count": n,
            "sentence_count": sentences,
            "avg_word_length": share(F.length(F.array_join("__w", "")), n),
            "avg_sentence_length": share(n, sentences),
            "punctuation_count": count_of(x, r"[.,!?;:]"),
            "uppercase_count": count_of(x, r"\p{Lu}"),
            "digit_count": count_of(x, r"\p{Nd}"),
            "whitespace_ratio": share(count_of(x, r"\s"), F.length(x)),
        }
        out = add(df, {f"{c}_{k}": e for k, e in made.items()}).drop("__w")
        if self.include_readability:
            out = ReadabilityScoreExtractor(columns=[c]).apply(out, {}, {})
        return self.pos_tagger(out, c) if self.include_pos and self.pos_tagger else out


class ReadabilityScoreExtractor(Operator):
    """Published formulas over characters, words, sentences and vowel groups as syllables; 0 without words."""

    defaults = {"columns": None, "metrics": ("flesch_reading_ease", "flesch_kincaid_grade", "smog_index", "coleman_liau_index", "automated_readability_index")}

    def apply(self, df, state, tables):
        for c in chosen(df, self.columns, string_columns(df)):
            x = text(c)
            vowels = lambda t: F.greatest(F.lit(1), count_of(F.lower(t), "[aeiouy]+"))
            df = df.withColumn("__w", F.filter(F.split(x, r"[^A-Za-z']+"), lambda t: t != "")).withColumn("__v", F.transform("__w", vowels))
            n = F.size("__w").cast("double")
            s = F.greatest(F.lit(1), count_of(x, r"[.!?]+")).cast("double")
            letters = F.length(F.array_join("__w", "")).cast("double")
            syllables = F.aggregate("__v", F.lit(0), lambda a, b: a + b).cast("double")
            hard = F.size(F.filter("__v", lambda k: k >= 3)).cast("double")
            known = {
                "flesch_reading_ease": 206.835 - 1.015 * n / s - 84.6 * F.try_divide(syllables, n),
                "flesch_kincaid_grade": 0.39 * n / s + 11.8 * F.try_divide(syllables, n) - 15.59,
                "smog_index": 1.043 * F.sqrt(hard * 30 / s) + 3.1291,
                "coleman_liau_index": 0.0588 * F.try_divide(letters, n) * 100 - 0.296 * F.try_divide(s, n) * 100 - 15.8,
                "automated_readability_index": 4.71 * F.try_divide(letters, n) + 0.5 * n / s - 21.43,
            }
            if bad := set(self.metrics) - set(known):
                raise ConfigurationError("unknown readability metric", metrics=sorted(bad))
            df = add(df, {f"{c}_{m}": F.when(n > 0, known[m]).otherwise(0.0) for m in self.metrics}).drop("__w", "__v")
        return df


class TextPreprocessor(Operator):
    """Lower-case, strip, stop words; `stemmer` is a function of a column, for those who have one."""

    defaults = {"columns": None, "lowercase": True, "remove_special_chars": False, "remove_stopwords": False, "stemmer": None, "stopwords": None}

    def apply(self, df, state, tables):
        made = {}
        for c in chosen(df, self.columns, string_columns(df)):
            x = text(c)
            x = F.lower(x) if self.lowercase else x
            x = F.regexp_replace(x, r"[^a-zA-Z0-9\s]", " ") if self.remove_special_chars else x
            if self.remove_stopwords:
                stop = F.array(*[F.lit(s) for s in (self.stopwords or STOPWORDS)])
                x = F.array_join(F.filter(tokens(x), lambda t: ~F.array_contains(stop, F.lower(t))), " ")
            made[c] = self.stemmer(x) if self.stemmer else x
        return add(df, made)


def with_row_numbers(df: DataFrame) -> DataFrame:
    """df with __r, a number for each row. It is written, as two evaluations of a plan need not number rows alike."""
    return stage(df.withColumn("__r", F.monotonically_increasing_id()), "rows")


class _Hook(Operator):
    """Outputs of an external model, a function DataFrame -> DataFrame. Without one it is an error, or zeros if `without_backend` asks for them."""

    outputs: tuple[str, ...] = ()

    def apply(self, df, state, tables):
        if not self.backend and self.without_backend != "zeros":
            raise MissingBackendError(f"{type(self).__name__} needs a backend(df, column, names), or without_backend='zeros'")
        for c in chosen(df, self.columns, string_columns(df)):
            names = [f"{c}_{o}" for o in self.names()]
            df = self.backend(df, c, names) if self.backend else add(df, {n: F.lit(0.0) for n in names})
        return df

    def names(self) -> list[str]:
        return list(self.outputs)


class SentimentAnalyzer(_Hook):
    """With a lexicon {word: score}, polarity is the mean score of scored words and subjectivity their share."""

    defaults = {"columns": None, "method": "lexicon", "lexicon": None, "backend": None, "without_backend": "error"}

    def names(self):
        return ["compound", "pos"] if self.method == "vader" else ["polarity", "subjectivity"]

    def apply(self, df, state, tables):
        if not self.lexicon or self.backend:
            return super().apply(df, state, tables)
        table = df.sparkSession.createDataFrame(list(self.lexicon.items()), "w string, s double")
        for c in chosen(df, self.columns, string_columns(df)):
            d = with_row_numbers(df)
            hits = d.select("__r", F.explode(tokens(F.lower(text(c)), r"[^\p{L}']+")).alias("w")).join(F.broadcast(table), "w", "left")
            s = hits.groupBy("__r").agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias(f"{c}_{self.names()[0]}"), (F.count("s") / F.count(F.lit(1))).alias(f"{c}_{self.names()[1]}"))
            df = d.join(s, "__r", "left").fillna(0.0, [f"{c}_{n}" for n in self.names()]).drop("__r")
        return df


class SentenceEmbeddingFeatures(_Hook):
    defaults = {"columns": None, "model_name": None, "dims": 384, "batch_size": 32, "max_length": 128, "backend": None, "without_backend": "error"}

    def names(self):
        return [f"sent_emb_{i}" for i in range(self.dims)]


class NERFeatureExtractor(_Hook):
    defaults = {"columns": None, "model_name": None, "entity_types": ("PERSON", "ORG", "GPE", "DATE", "MONEY", "PRODUCT"), "backend": None, "without_backend": "error"}

    def names(self):
        return ["entity_count", *[f"{t.lower()}_count" for t in self.entity_types]]


#: Words that one task trains word vectors on.
WORDS_A_TASK = 2_000_000


class WordEmbeddingFeatures(Operator):
    """Mean, max or sum of word vectors from a table (word, vector): given, read from a text file, or trained here.

    Training takes all texts, in one task up to WORDS_A_TASK words. More are trained on side by side in equal parts of about
    that size, and a word's vector is the mean of those of the parts that hold it.
    """

    defaults = {"column": None, "row_id": None, "dims": 100, "aggregation": "mean", "pretrained_path": None, "train": False, "random_state": 42}

    def learn(self, df):
        from tessera.sources.readers import read_word_vectors

        if self.pretrained_path:
            t = read_word_vectors(df.sparkSession, self.pretrained_path, self.dims)
        elif self.train:
            from pyspark.ml.feature import Word2Vec
            from pyspark.ml.functions import vector_to_array

            data = df.select(tokens(F.lower(text(self.column))).alias("t"))
            words = scalars(data, {"n": F.sum(F.size("t"))})["n"] or 0
            parts = max(1, -(-words // WORDS_A_TASK))
            t = Word2Vec(vectorSize=self.dims, minCount=1, seed=self.random_state, numPartitions=parts, inputCol="t", outputCol="o").fit(data).getVectors().select("word", vector_to_array("vector").alias("vector"))
        else:
            return {"rows": 0}, {}
        return {"rows": t.count()}, {"vectors": t}

    def apply(self, df, state, tables):
        names = [f"{self.column}_wemb_{i}" for i in range(self.dims)]
        if "vectors" not in tables:
            return add(df, {n: F.lit(0.0) for n in names})
        d = with_row_numbers(df)
        words = d.select("__r", F.explode(tokens(F.lower(text(self.column)))).alias("word")).groupBy("__r", "word").agg(F.count(F.lit(1)).alias("n"))
        t = F.broadcast(tables["vectors"]) if state["rows"] <= 100_000 else tables["vectors"]
        hit = words.join(t, "word")
        at = [F.col("vector")[i] for i in range(self.dims)]
        agg = {"mean": lambda v: F.sum(v * F.col("n")) / F.sum("n"), "sum": lambda v: F.sum(v * F.col("n")), "max": F.max}[self.aggregation]
        sums = hit.groupBy("__r").agg(*[agg(v).alias(n) for v, n in zip(at, names)])
        return d.join(sums, "__r", "left").fillna(0.0, names).drop("__r")


class TopicModelingFeatures(Operator):
    defaults = {"column": None, "n_topics": 10, "max_features": 5000, "max_iter": 10, "random_state": 42}

    def learn(self, df):
        from pyspark import StorageLevel
        from pyspark.ml import Pipeline, PipelineModel
        from pyspark.ml.clustering import LDA
        from pyspark.ml.feature import CountVectorizer, RegexTokenizer, StopWordsRemover

        data = df.select(text(self.column).alias("t"))
        counted = Pipeline(stages=[
            RegexTokenizer(inputCol="t", outputCol="w", pattern=r"\w\w+", gaps=False),
            StopWordsRemover(inputCol="w", outputCol="s", stopWords=list(STOPWORDS)),
            CountVectorizer(inputCol="s", outputCol="features", vocabSize=self.max_features, minDF=2),
        ]).fit(data)
        # every round samples the rows: their counts are made once, in the partitions of the table
        rows = counted.transform(data).select("features").persist(StorageLevel.DISK_ONLY)
        topics = LDA(k=self.n_topics, maxIter=self.max_iter, seed=self.random_state).fit(rows)
        rows.unpersist()
        return {}, {"topics": PipelineModel([*counted.stages, topics])}

    def apply(self, df, state, tables):
        from pyspark.ml.functions import vector_to_array

        out = tables["topics"].transform(df.withColumn("t", text(self.column))).withColumn("__a", vector_to_array("topicDistribution"))
        return add(out, {f"{self.column}_topic_{i}": F.col("__a")[i] for i in range(self.n_topics)}).drop("t", "w", "s", "features", "topicDistribution", "__a")


class TfidfVectorizer(Operator):
    """Word or character n-grams, weighted tf * (ln((1 + n) / (1 + df)) + 1) and normalised; a sparse map per row.

    The vocabulary is a table (term, index, idf), bounded by max_features; with use_hashing terms hash into buckets.
    """

    defaults = {"column": None, "max_features": 20_000, "ngram_range": (1, 2), "char_ngrams": False, "remove_stopwords": False, "min_df": 1, "use_hashing": False, "hashing_features": 16_384, "output": "tfidf"}

    def with_words(self, df: DataFrame) -> DataFrame:
        """Add __w, words as a column of its own, so that n-grams don't split the text again for each place."""
        x = F.lower(text(self.column))
        if self.char_ngrams:
            return df.withColumn("__w", F.transform(tokens(x), lambda w: F.concat(F.lit(" "), w, F.lit(" "))))
        w = F.filter(F.split(x, r"\W+"), lambda t: F.length(t) > 1)
        if self.remove_stopwords:
            stop = F.array(*[F.lit(s) for s in STOPWORDS])
            w = F.filter(w, lambda t: ~F.array_contains(stop, t))
        return df.withColumn("__w", w)

    def terms(self) -> Column:
        w = F.col("__w")
        if self.char_ngrams:

            def pieces(n):
                return F.flatten(F.transform(w, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))))

            return F.concat(*[pieces(n) for n in (3, 4, 5)])
        def grams(n):
            if n == 1:
                return w
            m = F.greatest(F.size(w) - n + 1, F.lit(0))
            shifted = F.arrays_zip(*[F.slice(w, F.when(m > 0, k + 1).otherwise(1), m).alias(f"w{k}") for k in range(n)])
            return F.transform(shifted, lambda z: F.concat_ws(" ", *[z[f"w{k}"] for k in range(n)]))

        lo, hi = self.ngram_range
        return F.concat(*[grams(n) for n in range(lo, hi + 1)])

    def learn(self, df):
        n = df.count()
        if self.use_hashing:
            return {"n": n}, {}
        d = self.with_words(df).select(F.explode(F.array_distinct(self.terms())).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= self.min_df)
        top = d.orderBy(F.desc("df"), "term").limit(self.max_features)
        t = top.withColumn("idf", F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
        return {"n": n, "rows": self.max_features}, {"vocabulary": t}

    def apply(self, df, state, tables):
        d = with_row_numbers(df)
        rows = self.with_words(d).select("__r", F.explode(self.terms()).alias("term"))
        if self.use_hashing:
            rows = rows.withColumn("term", F.pmod(F.hash("term"), F.lit(self.hashing_features)).cast("string"))
        tf = rows.groupBy("__r", "term").agg(F.count(F.lit(1)).alias("tf"))
        if self.use_hashing:
            weights = tf.withColumn("x", F.col("tf").cast("double"))
        else:
            v = tables["vocabulary"]
            weights = tf.join(F.broadcast(v) if state["rows"] <= 100_000 else v, "term").withColumn("x", F.col("tf") * F.col("idf"))
        vec = weights.groupBy("__r").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.map_from_entries(F.collect_list(F.struct("term", "x"))).alias("m"))
        vec = vec.select("__r", F.transform_values("m", lambda k, x: x / F.col("norm")).alias(f"{self.column}_{self.output}"))
        return d.join(vec, "__r", "left").drop("__r")


class TextSVD(Operator):
    """Truncated SVD of a column of sparse maps (term: weight), by subspace iteration: each round is one pass that adds up a terms x components matrix.

    The fitted state has one row per term, at most max_terms. Rows without a known term get zeros.
    """

    defaults = {"column": None, "n_components": 50, "n_iter": 5, "oversample": 10, "max_terms": 200_000, "prefix": None, "random_state": 42}

    def learn(self, df):
        import numpy as np
        import pandas as pd

        weights = stage(df.select(F.map_keys(self.column).alias("k"), F.map_values(self.column).alias("v")).filter(F.size("k") > 0), "svd-rows")
        terms = [r[0] for r in weights.select(F.explode("k").alias("k")).distinct().orderBy("k").limit(self.max_terms + 1).collect()]
        if len(terms) > self.max_terms:
            raise InputValidationError("too many terms for an SVD", limit=self.max_terms)
        width = min(self.n_components + self.oversample, max(1, len(terms)))
        spark = df.sparkSession
        at = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

        def passed(basis: np.ndarray) -> np.ndarray:
            """A'A basis."""
            shared = spark.sparkContext.broadcast(basis)

            def run(parts):
                total = np.zeros_like(shared.value)
                for pdf in parts:
                    for k, v in zip(pdf["k"], pdf["v"]):
                        i, x = [at.value[t] for t in k], np.asarray(v, float)
                        total[i] += np.outer(x, x @ shared.value[i])
                used = np.flatnonzero(np.abs(total).sum(axis=1))
                for lo in range(0, len(used), 5000):
                    rows = used[lo : lo + 5000]
                    yield pd.DataFrame({"i": np.repeat(rows, width), "j": np.tile(np.arange(width), len(rows)), "x": total[rows].ravel()})

            out = np.zeros_like(basis)
            for r in weights.mapInPandas(run, "i long, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # terms x components numbers
                out[r.i, r.j] = r.x
            shared.unpersist()
            return out

        q = np.linalg.qr(np.random.default_rng(self.random_state).normal(size=(len(terms), width)))[0] if terms else np.zeros((0, width))
        for _ in range(self.n_iter if terms else 0):
            q = np.linalg.qr(passed(q))[0]
        b = q.T @ passed(q) if terms else np.zeros((width, width))
        values, vectors = np.linalg.eigh((b + b.T) / 2)
        order = np.argsort(-values)[: self.n_components]
        comp = (q @ vectors[:, order]).T
        if terms:
            comp *= np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(axis=1)])[:, None]
        rows = [(t, [float(x) for x in comp[:, i]]) for i, t in enumerate(terms)]
        return {"rows": len(rows), "n": len(order), "singular": np.sqrt(np.maximum(values[order], 0)).tolist()}, {"terms": spark.createDataFrame(rows, "term string, components array<double>")}

    def apply(self, df, state, tables):
        n, prefix = state["n"], self.prefix or f"{self.column}_svd"
        d = with_row_numbers(df)
        each = d.select("__r", F.explode(self.column).alias("term", "x"))
        t = F.broadcast(tables["terms"]) if state["rows"] <= 100_000 else tables["terms"]
        sums = each.join(t, "term").groupBy("__r").agg(*[F.sum(F.col("x") * F.col("components")[i]).alias(f"{prefix}_{i}") for i in range(n)])
        return d.join(sums, "__r", "left").fillna(0.0, [f"{prefix}_{i}" for i in range(n)]).drop("__r")


def build_text_pipeline(column_name: str, max_features: int = 20_000, svd_components: int | None = None, use_hashing: bool = False, hashing_features: int = 16_384, char_ngrams: bool = False, ngram_range=(1, 2), remove_stopwords: bool = False, min_df: int = 1) -> list[tuple[str, Operator]]:
    v = TfidfVectorizer(column=column_name, max_features=max_features, ngram_range=ngram_range, char_ngrams=char_ngrams, remove_stopwords=remove_stopwords, min_df=min_df, use_hashing=use_hashing, hashing_features=hashing_features)
    out: list[tuple[str, Operator]] = [("tfidf", v)]
    if svd_components:
        name = f"{column_name}_{v.output}"
        out.append(("svd", TextSVD(column=name, n_components=svd_components)))
    return out


def build_comprehensive_text_pipeline(column_name: str, statistics: bool = True, readability: bool = True, topics: int = 0, tfidf: bool = True, **kw) -> list[tuple[str, Operator]]:
    out: list[tuple[str, Operator]] = []
    if statistics:
        out.append(("statistics", TextStatisticsExtractor(columns=[column_name], extract_linguistic=True)))
    if readability:
        out.append(("readability", ReadabilityScoreExtractor(columns=[column_name])))
    if topics:
        out.append(("topics", TopicModelingFeatures(column=column_name, n_topics=topics)))
    return out + (build_text_pipeline(column_name, **kw) if tfidf else [])


def document_frequencies(df: DataFrame, column: str, **kw) -> DataFrame:
    v = TfidfVectorizer(column=column, **kw)
    return v.learn(df)[1]["vocabulary"]
