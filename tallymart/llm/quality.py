"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text gives each document a perplexity.

Units are whole characters, so every script is modelled alike: those of the basic plane as they are (white space as one), the rarer
ones in as many classes as the plane has free places. An ``ORDER``-gram is one long; its context and its suffix are shifts of it.

Trusted documents are those labelled good and not toxic. They are dealt to two folds by a hash of the text, and so is every other
document: each fold has a model, and a document is scored by the model of the other fold, which has not seen it, nor any copy
of it. Counts cover every trusted document, and all count tables grow with them: they are sharded by n-gram, and discounts,
context totals and lower orders are joined to them, order by order.

Documents meet the model by joins as well. The distinct n-grams of all documents, reduced within tasks first, are joined to the
count tables, and those that a model has not seen back off through the lower orders. What comes out, one row for each n-gram that
occurs, is joined to each document's counts: the ``HOT`` most frequent n-grams are broadcast, all others are joined by shuffles.

A document's cross-entropy is drawn towards its language's trusted mean as if it had ``PRIOR`` more characters, since short texts
scatter. A document is rejected if it lies above the ``QUANTILE`` of its language's trusted documents, which are scored in the same
way, out of their fold; languages without trusted documents use all of them.

A text that repeats itself has a low perplexity. So a document's evenness, the entropy of its own n-gram counts over the
logarithm of its length, is drawn towards the trusted mean in the same way, and a document below the 1 - ``QUANTILE`` of its
language's trusted documents repeats.

Null texts count as empty: they take their language's mean and are kept. Null languages are a language of their own. Repeated
rows are scored alike; labels without documents, null labels and repeated labels change nothing. Without any trusted document
every n-gram is equally likely and everything is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import SLOTS, likely, settle

#: Characters of an n-gram, bits and number of characters.
ORDER, BITS = 4, 16
CHARACTERS = 1 << BITS
PRIOR, QUANTILE, LEAST_CUT = 100.0, 0.999, 0.1
#: Cross-entropies are compared in steps of this size, so that quantiles are exact sums of counts.
STEP = 1 / 1024
#: N-grams that are broadcast, with a number for each fold (24 bytes each), and codes that a task holds before it adds them up.
HOT, HELD = 1 << 19, 1 << 20
#: Documents that a task turns over at once.
DOCS = 128
#: First of the places, 8,448 in number, that no character of the basic plane has (surrogates and private use), and white space.
FREE, FREE_SIZE = 0xD800, 0xF900 - 0xD800
SPACES = np.array([cp for cp in range(CHARACTERS) if chr(cp).isspace() or cp == 0], dtype=np.uint32)


def ngrams(text: str) -> np.ndarray:
    """Code of the ORDER-gram that ends at each character; the text is preceded by white space."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    s = np.concatenate([np.full(ORDER - 1, 32, dtype=np.uint32), cps])
    s[np.isin(s, SPACES)] = 32
    rare = s >= CHARACTERS
    s[rare] = FREE + (s[rare] * np.uint32(2654435761) >> np.uint32(12)) % np.uint32(FREE_SIZE)
    code = np.zeros(len(cps), dtype=np.uint64)
    for i in range(ORDER):
        code = code << np.uint64(BITS) | s[i : i + len(cps)]
    return code.view(np.int64)


class _Counts:
    """Counts of codes; memory follows the distinct codes and ``HELD``."""

    def __init__(self) -> None:
        self.code, self.n, self.more, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), [], 0

    def add(self, codes: np.ndarray) -> None:
        self.more.append(codes)
        self.size += len(codes)
        if self.size > HELD:
            self.shrink()

    def shrink(self) -> None:
        code, n = np.unique(np.concatenate([*self.more, np.zeros(0, dtype=np.int64)]), return_counts=True)
        code, n = np.concatenate([self.code, code]), np.concatenate([self.n, n])
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, dtype=np.int64)
        self.code, self.n = code[first], np.add.reduceat(n, first) if len(first) else n
        self.more, self.size = [], 0


def counted(texts: DataFrame) -> DataFrame:
    """(fold, code, n) of all n-grams of ``texts`` (fold int, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Counts] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for fold, c in held.items():
                c.shrink()
                for at in range(0, len(c.code), HELD):
                    code, n = c.code[at : at + HELD], c.n[at : at + HELD]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), fold, dtype=np.int32)), pa.array(code), pa.array(n)], ["fold", "code", "n"])
            held.clear()

        for batch in batches:
            for fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(fold, _Counts()).add(ngrams(text or ""))
            if sum(len(c.code) for c in held.values()) > HELD:
                yield from rows()
        yield from rows()

    each = texts.select("fold", "text").mapInArrow(count, "fold int, code long, n long")
    return each.groupBy("fold", "code").agg(F.sum("n").alias("n"))


def _context(code: Column) -> Column:
    return F.shiftrightunsigned(code, BITS)


def _suffix(code: Column, order: int) -> Column:
    """The last ``order`` characters of a code."""
    return code if order >= ORDER else code.bitwiseAND(F.lit((1 << BITS * order) - 1).cast("long"))


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (with doc_id) labelled quality 1 and toxic 0 (null toxic: 0). A filter over hashed ids goes before the exact join."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("key")).distinct()
    # The slot is part of the key so that the filter stays below the shuffle.
    ids = good.select(F.col("key").alias("good"), F.floor(F.pmod(F.xxhash64("key"), F.lit(SLOTS)) / 64).alias("good_slot"))
    some = likely(docs, F.col("doc_id").cast("long"), good)
    return some.join(ids, (F.col("doc_id") == F.col("good")) & (F.col("slot") == F.col("good_slot")), "left_semi").drop("slot")


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What modified Kneser-Ney takes off counts of 1, of 2, and of 3 and more; 0.5 where counts of counts are missing. Never less
    than ``LEAST_CUT``: copied texts turn the estimate negative, and without a cut nothing were left for what is unseen."""
    y, n = n1 / (n1 + 2 * n2) if n1 else 0.0, [n1, n2, n3, n4]
    return [min(float(i), max(LEAST_CUT, i - (i + 1) * y * n[i] / n[i - 1])) if n1 and n[i - 1] else 0.5 for i in (1, 2, 3)]


def model(counts: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order the seen n-grams (fold, code, p) and the contexts' shares for others (fold, context, gamma), from the
    ``counts`` (fold, code, n) of the highest order."""
    tables = {ORDER: settle(counts, "lm-counts")}
    # Below the highest order, what counts is the number of characters that precede a gram.
    for order in range(ORDER - 1, 0, -1):
        shorter = tables[order + 1].groupBy("fold", _suffix(F.col("code"), order).alias("code"))
        tables[order] = settle(shorter.agg(F.count("*").alias("n")), f"lm-counts-{order}")
    found: dict[int, tuple[DataFrame, DataFrame]] = {}
    for order in range(1, ORDER + 1):
        # Four numbers for each fold: the counts of counts that give the discounts.
        coc = tables[order].groupBy("fold").agg(*[F.count(F.when(F.col("n") == i, 1)) for i in range(1, 5)]).collect()
        cut = F.lit(0.5)
        for fold, *some in coc:
            cuts = [F.lit(c) for c in discounts(*some)]
            cut = F.when(F.col("fold") == fold, F.when(F.col("n") == 1, cuts[0]).when(F.col("n") == 2, cuts[1]).otherwise(cuts[2])).otherwise(cut)
        rows = tables[order].select("fold", "code", "n", cut.alias("cut"), _context(F.col("code")).alias("context"))
        context = rows.groupBy("fold", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("spare"))
        context = settle(context, f"lm-contexts-{order}")
        rows = rows.join(context, ["fold", "context"])
        if order == 1:
            rows = rows.withColumn("lower", F.lit(1.0 / CHARACTERS))
        else:
            lower = found[order - 1][0].select("fold", F.col("code").alias("suffix"), F.col("p").alias("lower"))
            rows = rows.withColumn("suffix", _suffix(F.col("code"), order - 1)).join(lower, ["fold", "suffix"])
        p = (F.col("n") - F.col("cut") + F.col("spare") * F.col("lower")) / F.col("total")
        found[order] = settle(rows.select("fold", "code", p.alias("p")), f"lm-{order}"), context.select("fold", "context", (F.col("spare") / F.col("total")).alias("gamma"))
    return found


def resolved(codes: DataFrame, seen: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(code, logp0, logp1): what the model of each fold gives to ``codes`` (distinct code), seen or not."""
    below = None
    for order in range(1, ORDER + 1):
        rows = codes.select(_suffix(F.col("code"), order).alias("code"))
        rows = (rows if order == ORDER else rows.distinct()).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("fold"), "code")
        grams, contexts = seen[order]
        rows = rows.join(grams, ["fold", "code"], "left").withColumn("context", _context(F.col("code"))).join(contexts, ["fold", "context"], "left")
        if below is None:
            rows = rows.withColumn("lower", F.lit(1.0 / CHARACTERS))
        else:
            rows = rows.withColumn("suffix", _suffix(F.col("code"), order - 1)).join(below.select("fold", F.col("code").alias("suffix"), F.col("p").alias("lower")), ["fold", "suffix"])
        p = F.coalesce("p", F.coalesce("gamma", F.lit(1.0)) * F.col("lower"))
        below = settle(rows.select("fold", "code", p.alias("p")), f"lm-resolved-{order}")
    of = lambda fold: F.max(F.when(F.col("fold") == fold, F.log("p"))).alias(f"logp{fold}")
    return below.groupBy("code").agg(of(0), of(1))


def _fold(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(2)).cast("int")


def _hot_sums(docs: DataFrame, hot) -> DataFrame:
    """``docs`` (doc_id, lang, key, fold, text) with bits (summed over the ``hot`` n-grams), n, evenness and, in cold, the others."""
    item = pa.struct([("code", pa.int64()), ("n", pa.int32())])

    def evenness(n: np.ndarray) -> float:
        total = n.sum()
        return float((np.log(total) - (n * np.log(n)).sum() / total) / np.log(total + 1)) if total else 0.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, logp = hot.value
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                bits, size, even, cold = [], [], [], []
                for fold, text in zip(part.column(3).to_pylist(), part.column(4).to_pylist()):
                    code, n = np.unique(ngrams(text or ""), return_counts=True)
                    place = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
                    known = codes[place] == code if len(codes) else np.zeros(len(code), dtype=bool)
                    # The model of the other fold.
                    bits.append(-float((n[known] * logp[1 - fold][place[known]]).sum()))
                    size.append(int(n.sum()))
                    even.append(evenness(n))
                    cold.append((code[~known], n[~known].astype(np.int32)))
                ends = pa.array(np.cumsum([0, *(len(c) for c, _ in cold)]).astype(np.int32))
                rest = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(np.concatenate([c[i] for c in cold])) for i in (0, 1)], fields=list(item)))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(bits), pa.array(size, pa.int64()), pa.array(even), rest], ["doc_id", "lang", "key", "fold", "bits", "n", "even", "cold"])

    types = dict(docs.dtypes)
    schema = f"doc_id {types['doc_id']}, lang {types['lang']}, key long, fold int, bits double, n long, even double, cold array<struct<code: long, n: int>>"
    return docs.select("doc_id", "lang", "key", "fold", "text").mapInArrow(count, schema)


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, key, bits, n, even): summed negative log-probability, characters and evenness of each distinct document, however
    often its row occurs; key: hash of the text."""
    spark = docs.sparkSession
    known = trusted(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels)
    seen = model(counted(known.select(_fold(F.col("text")).alias("fold"), "text")))
    codes = settle(counted(docs.select(F.lit(0).alias("fold"), F.col(text).alias("text"))).select("code", "n"), "lm-codes")
    table = settle(resolved(codes.select("code"), seen).join(codes, "code"), "lm-table")
    top = table.orderBy(F.col("n").desc(), "code").limit(HOT).select("code", "n", "logp0", "logp1").toArrow().sort_by("code")  # HOT rows at most
    column = lambda n: top.column(n).combine_chunks().to_numpy(zero_copy_only=False)
    hot = spark.sparkContext.broadcast((column("code").astype(np.int64), (column("logp0").astype(np.float64), column("logp1").astype(np.float64))))
    n, code = column("n"), column("code")
    last = (int(n.min()), int(code[n == n.min()].max())) if len(n) else (0, 0)
    cold = table.where((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("code") > last[1]))).select("code", "logp0", "logp1")

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), _fold(F.col(text)).alias("fold"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = settle(_hot_sums(rows, hot), "lm-sums")
    each = rows.where(F.size("cold") > 0).select("doc_id", "lang", "key", "fold", F.inline("cold").alias("code", "n")).join(cold, "code")
    other = F.when(F.col("fold") == 0, F.col("logp1")).otherwise(F.col("logp0"))
    each = each.groupBy("doc_id", "lang", "key").agg(F.sum(-F.col("n") * other).alias("bits")).select("doc_id", "lang", "key", "bits", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("even"), F.lit(0).alias("rows"))
    sums = rows.select("doc_id", "lang", "key", "bits", "n", "even", F.lit(1).alias("rows")).unionByName(each).groupBy("doc_id", "lang", "key")
    # Repeated rows have the same characters and probabilities: one of them counts.
    return sums.agg((F.sum("bits") / F.sum("rows")).alias("bits"), (F.sum("n") / F.sum("rows")).cast("long").alias("n"), F.max("even").alias("even"))


def judge(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """``scored`` (settled scores) with perplexity, threshold (a perplexity too), repeats, and keep (neither above it nor repeating)."""
    good = trusted(scored, labels)
    means = good.groupBy("lang").agg(F.try_divide(F.sum("bits"), F.sum("n")).alias("mean"), F.try_divide(F.sum(F.col("even") * F.col("n")), F.sum("n")).alias("mean_even"))
    every = good.agg(F.try_divide(F.sum("bits"), F.sum("n")), F.try_divide(F.sum(F.col("even") * F.col("n")), F.sum("n"))).first()
    any_mean, any_even = every[0] or math.log(CHARACTERS), every[1] or 0.0
    langs = scored.select("lang").distinct()
    means = langs.join(means.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left")
    means = settle(means.select("lang", F.coalesce("mean", F.lit(any_mean)).alias("mean"), F.coalesce("mean_even", F.lit(any_even)).alias("mean_even")), "quality-means")

    def entropy(df: DataFrame) -> DataFrame:
        m = means.withColumnRenamed("lang", "l")
        joined = df.join(m, F.col("lang").eqNullSafe(F.col("l"))).drop("l")
        joined = joined.withColumn("even_step", F.floor((F.col("even") * F.col("n") + PRIOR * F.col("mean_even")) / (F.col("n") + PRIOR) / STEP))
        return joined.withColumn("entropy", (F.col("bits") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR))

    ranked = settle(entropy(good).select("lang", F.floor(F.col("entropy") / STEP).alias("step"), "even_step"), "quality-ranked")
    count = lambda step: ranked.groupBy("lang", F.col(step).alias("step")).agg(F.count("*").alias("n"))
    steps, evens = settle(count("step"), "quality-steps"), settle(count("even_step"), "quality-evens")

    def lowest(per: list[str]) -> DataFrame:
        """Step of evenness that holds the 1 - QUANTILE."""
        w = W.partitionBy(*per) if per else W.partitionBy(F.lit(0))
        each = evens.groupBy(*per, "step").agg(F.sum("n").alias("n"))
        upto, total = F.sum("n").over(w.orderBy("step")), F.sum("n").over(w)
        reached = each.withColumn("upto", upto).withColumn("total", total).where(F.col("upto") > (1 - QUANTILE) * F.col("total"))
        return reached.groupBy(*per).agg(F.min("step").alias("least"))

    def quantile(per: list[str]) -> DataFrame:
        """Upper end of the step that holds the quantile; a window runs over the steps of a language."""
        w = W.partitionBy(*per) if per else W.partitionBy(F.lit(0))
        each = steps.groupBy(*per, "step").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(w.orderBy("step"))
        total = F.sum("n").over(w)
        reached = each.withColumn("upto", upto).withColumn("total", total).where(F.col("upto") >= QUANTILE * F.col("total"))
        return reached.groupBy(*per).agg(((F.min("step") + 1) * F.lit(STEP)).alias("limit"))

    limits = langs.join(quantile(["lang"]).withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
    limits = limits.join(lowest(["lang"]).withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left")
    any_limit, any_least = ((q([]).first() or [None])[0] for q in (quantile, lowest))
    limits = limits.select(F.col("lang").alias("l"), F.coalesce("limit", F.lit(any_limit).cast("double")).alias("limit"), F.coalesce("least", F.lit(any_least).cast("long")).alias("least"))
    limits = settle(limits, "quality-limits")
    judged = entropy(scored).join(limits, F.col("lang").eqNullSafe(F.col("l"))).drop("l")
    keep = F.coalesce(F.col("entropy") <= F.col("limit"), F.lit(True))
    repeats = F.coalesce(F.col("even_step") < F.col("least"), F.lit(False))
    return judged.select("doc_id", "lang", "key", F.exp("entropy").alias("perplexity"), F.exp("limit").alias("threshold"), (keep & ~repeats).alias("keep"), repeats.alias("repeats"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, key, perplexity, threshold, keep, repeats), one row for each distinct (doc_id, lang, text)."""
    return judge(settle(scores(docs, labels, doc_id, text, lang), "quality-scores"), labels)


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps and that do not repeat themselves, with all their columns."""
    kept = classify(docs, labels, doc_id, text, lang).where("keep").select(F.col("doc_id").alias("d"), F.col("lang").alias("l"), F.col("key").alias("k"))
    whole = docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("own"), F.col(lang).alias("tongue"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"))
    same = F.col("own").eqNullSafe(F.col("d")) & F.col("tongue").eqNullSafe(F.col("l")) & (F.col("key") == F.col("k"))
    return whole.join(settle(kept, "quality-kept"), same, "left_semi").select("doc.*")
