"""Quality rules, native: counts on words and lines, and the divergence of a
document's histograms from language references. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, unused

#: Common words of each language, lower case: fixed values, public stop words.
COMMON_WORDS = {
    "de": "die der und in zu den das nicht von sie ist des sich mit dem dass er es ein ich auf so eine auch als an nach wie im für".split(),
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which a".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou aux".split(),
}
#: Classes of the characters of words; what none of them takes is ``other``.
CLASSES = ("lower", "upper", "digit", "letter", "mark", "other")
_WHITE = r"[\x20\x09-\x0D]"
#: Shares are summed as whole millionths, so that sums don't depend on order.
UNIT = 1_000_000
#: The method judges a histogram from this many words or characters on; a few
#: numbers or names sway the histograms of shorter texts.
MIN_WORDS = 60
MIN_CHARS = 250
#: Largest Jensen-Shannon distances (base 2, from 0 to 1) of a kept document: of
#: the character classes alone, and of both histograms added.
MAX_CHAR_DISTANCE = 0.30
MAX_JOINT_DISTANCE = 0.42


def _once(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """``keep`` and ``made``, each evaluated once: the optimizer merges
    neighbouring projections and would then work out a column that a lambda
    uses once per element; it doesn't merge them across a generator."""
    fields = [F.col(f"`{k}`") for k in keep]
    return df.select(*fields, F.inline(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))))


def _listed(words: list[str]):
    """Test of a word against a list, in lower case or with a first capital."""
    forms = [w for x in words for w in (x, x[:1].upper() + x[1:])]
    return lambda word: word.isin(forms)


def measure(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` (the columns ``keep`` of it, all by default) with a column for
    the base counts, the histograms and the language whose common words the text
    holds most of; and that column's name, which clashes with no other.
    Everything is worked out inside the row, so nothing is shuffled, however
    often a word or line is repeated.
    """
    names = list(docs.columns if keep is None else keep)
    (measured,) = unused(docs, "measured")
    own_columns = [f"__c{i}" for i in range(len(names))]
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, own_columns)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    t = F.col("__t")
    cut = lambda c, what: F.regexp_replace(c, what, "")
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    a = _once(
        rows,
        own_columns,
        total=F.length(t),
        words=F.filter(F.split(t, f"{_WHITE}+"), lambda w: w != ""),
        r1=cut(t, "[a-z]+"),
        lines=F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    )
    b = _once(
        a,
        [*own_columns, "total"],
        n_words=F.size("words").cast("long"),
        hashes=F.transform("words", lambda w: F.xxhash64(w)),
        common=F.filter("words", _listed(every)),
        lower=F.col("total") - F.length("r1"),
        r2=cut(F.col("r1"), f"{_WHITE}+"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    )
    window = lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + k) for k in range(5)])
    hits = {lang: F.size(F.filter("common", _listed(words))) for lang, words in COMMON_WORDS.items()}
    c = _once(
        b,
        [*own_columns, "n_words", "common", "n_dup_lines", "lower"],
        word_chars=(F.col("lower") + F.length("r2")).cast("long"),
        n_symbols=(F.length("r2") - F.length(cut(F.col("r2"), "[#*$%&|<>]+"))).cast("long"),
        windows=F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 5), window)).otherwise(F.array().cast("array<long>")),
        r2=F.col("r2"),
        r3=cut(F.col("r2"), "[A-Z]+"),
        hits=F.array(*[F.struct(h.alias("n"), F.lit(lang).alias("lang")) for lang, h in hits.items()]),
    )
    best = F.array_max("hits")
    own = F.coalesce(*[F.when(best["lang"] == lang, F.filter("common", _listed(words))) for lang, words in COMMON_WORDS.items()])
    d = _once(
        c,
        [*own_columns, "n_words", "n_dup_lines", "lower", "word_chars", "n_symbols"],
        lang=F.when(best["n"] > 0, best["lang"]),
        own=F.sort_array(F.transform(own, lambda w: F.lower(w))),
        upper=F.length("r2") - F.length("r3"),
        r3=F.col("r3"),
        r4=cut(F.col("r3"), "[0-9]+"),
        placed=F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:long,i:int>>")),
    )
    placed, listed = F.col("placed"), F.col("own")
    same = lambda e, i, k: F.coalesce(F.get(placed, i + k)["h"] == e["h"], F.lit(False))
    twice = F.filter("placed", lambda e, i: same(e, i, 1) | F.when(i > 0, same(e, i, -1)).otherwise(False))
    starts = F.filter(F.transform("own", lambda w, i: F.when((i == 0) | (F.get(listed, F.greatest(i - 1, F.lit(0))) != w), F.struct(w.alias("word"), i.alias("i")))), lambda x: x.isNotNull())
    e = _once(
        d,
        [*own_columns, "n_words", "n_dup_lines", "lower", "upper", "word_chars", "n_symbols", "lang"],
        n_own=F.size("own"),
        starts=starts,
        places=F.sort_array(F.transform(twice, lambda x: x["i"])),
        digit=F.length("r3") - F.length("r4"),
        r4=F.col("r4"),
        r5=cut(F.col("r4"), r"\p{L}+"),
    )
    mark = F.length("r5") - F.length(cut(F.col("r5"), r"[.,;:!?'\"()-]+"))
    begins, places = F.col("starts"), F.col("places")
    after = lambda i: F.coalesce(F.get(begins, i + 1)["i"], F.col("n_own"))
    f = _once(
        e,
        [*own_columns, "n_words", "n_dup_lines", "word_chars", "n_symbols", "lang"],
        counts=F.array(
            F.col("lower"), F.col("upper"), F.col("digit"), F.length("r4") - F.length("r5"), mark,
            F.length("r5") - mark,
        ),
        common=F.transform("starts", lambda x, i: F.struct(x["word"].alias("word"), (after(i) - x["i"]).alias("n"))),
        n_repeat_words=F.coalesce(
            F.aggregate(
                F.transform("places", lambda p, i: F.least(F.lit(5), F.coalesce(F.get(places, i + 1) - p, F.lit(5)))), F.lit(0).cast("long"), lambda s, x: s + x
            ),
            F.lit(0).cast("long"),
        ),
    )
    q = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lang", "counts", "common")
    return f.select(*[F.col(k).alias(c) for c, k in zip(names, own_columns)], q.alias(measured)), measured


def fit_references(measured: DataFrame, column: str) -> dict[str, dict[str, dict[str, float]]]:
    """Per language the mean histogram of its documents: shares of the character
    classes and of the common words. One pass over the measures of all
    documents; what reaches the driver is at most languages x (classes + common
    words) sums, a bound that the input does not move."""
    q = measured.select(F.col(column).alias("q")).select("q.*")
    q = q.where((F.col("n_words") >= MIN_WORDS) & (F.col("word_chars") >= MIN_CHARS) & F.col("lang").isNotNull())
    unit = lambda n, of: F.floor(n.cast("long") * UNIT / F.greatest(of, F.lit(1))).cast("long")
    shares = F.concat(
        F.array(*[F.struct(F.lit("class").alias("kind"), F.lit(k).alias("name"), unit(F.col("counts")[i], F.col("word_chars")).alias("share")) for i, k in enumerate(CLASSES)]),
        F.transform("common", lambda x: F.struct(F.lit("word").alias("kind"), x["word"].alias("name"), unit(x["n"], F.col("n_words")).alias("share"))),
    )
    sums = q.select("lang", F.inline(shares)).groupBy("lang", "kind", "name").agg(F.sum("share").alias("share"), F.count(F.lit(1)).alias("n"))
    found: dict[str, dict[str, dict[str, float]]] = {}
    rows = sums.collect()
    docs_of = {r["lang"]: r["n"] for r in rows if r["kind"] == "class"}
    for r in rows:
        found.setdefault(r["lang"], {"class": {}, "word": {}})[r["kind"]][r["name"]] = r["share"] / UNIT / docs_of[r["lang"]]
    return found


def _distance(terms: Column, rest: Column) -> Column:
    """Jensen-Shannon distance from the terms of present bins and the reference
    share of absent ones, each of which adds half its share."""
    return F.sqrt(F.greatest(F.aggregate(terms, rest / 2, lambda s, x: s + x), F.lit(0.0)))


def _term(p: Column, q: Column) -> Column:
    """(p log2(p/m) + q log2(q/m)) / 2 with m the mean; 0 log 0 is 0."""
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m) / 2).otherwise(F.lit(0.0))
    m = (p + q) / 2
    return half(p, m) + half(q, m)


def judge(measured: DataFrame, column: str, references: dict) -> tuple[DataFrame, str, str]:
    """``measured`` with the verdicts of the base rules and of all rules, and the
    names of these two columns (failed, kept). A distance that a guard or a
    missing reference leaves unjudged rejects nothing."""
    q = F.col(column)
    at_char, at_word, at_failed, at_kept = unused(measured, "char", "word", "failed", "kept")
    n, chars, lang = q["n_words"], q["word_chars"], q["lang"]

    def char_js(ref: dict) -> Column:
        terms = [_term(q["counts"][i] / F.greatest(chars, F.lit(1)), F.lit(ref["class"].get(k, 0.0))) for i, k in enumerate(CLASSES)]
        return _distance(F.array(*terms), F.lit(0.0))

    def word_js(ref: dict) -> Column:
        shares = ref["word"]
        total = sum(shares.values())
        lookup = F.create_map(*[F.lit(x) for kv in sorted(shares.items()) for x in kv]) if shares else F.create_map().cast("map<string,double>")
        known = lambda x: F.coalesce(lookup[x["word"]], F.lit(0.0))
        present = F.aggregate(q["common"], F.lit(0.0), lambda s, x: s + known(x))
        taken = F.aggregate(q["common"], F.lit(0).cast("long"), lambda s, x: s + x["n"])
        terms = F.transform(q["common"], lambda x: _term(x["n"] / F.greatest(n, F.lit(1)), known(x)))
        other = _term((n - taken) / F.greatest(n, F.lit(1)), F.lit(1.0 - total))
        return _distance(F.concat(terms, F.array(other)), F.lit(total) - present)

    if references:
        # A text without any common word has no language: the nearest reference
        # counts, unless most of it is in letters that no reference holds.
        chosen = F.coalesce(*[F.when(lang == k, char_js(r)) for k, r in sorted(references.items())])
        nearest = [char_js(r) for _, r in sorted(references.items())]
        nearest = F.least(*nearest) if len(nearest) > 1 else nearest[0]
        foreign = 2 * q["counts"][CLASSES.index("letter")].cast("long") > chars
        char = F.when(chars >= MIN_CHARS, F.when(lang.isNotNull(), chosen).when(~foreign, nearest))
        own_word = F.coalesce(*[F.when(lang == k, word_js(r)) for k, r in sorted(references.items())])
        near_word = [word_js(r) for _, r in sorted(references.items())]
        near_word = F.least(*near_word) if len(near_word) > 1 else near_word[0]
        word = F.when(n >= MIN_WORDS, F.when(lang.isNotNull(), own_word).when(~foreign, near_word))
    else:
        char = word = F.lit(None).cast("double")
    failed = (n < 10) | (100 * q["n_repeat_words"] > 20 * n)
    out = measured.withColumns({at_char: char, at_word: word, at_failed: failed})
    far = F.coalesce(F.col(at_char) > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(F.col(at_char) + F.col(at_word) > MAX_JOINT_DISTANCE, F.lit(False))
    return out.withColumn(at_kept, ~F.col(at_failed) & ~far), at_failed, at_kept


def judged(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> tuple[DataFrame, str, str, str]:
    """``docs`` measured and judged against its own references, and the names of
    the columns measured, failed and kept. Texts are measured once: the measures
    are written to the shared folder, and the references and the verdicts read
    from there."""
    rows, column = measure(docs, text, keep)
    rows = materialise(rows)
    return (*judge(rows, column, fit_references(rows, column)), column)


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, all columns as they were, whatever
    they are called.

    A null or empty text has no words and fails the base rule. Short texts that
    pass it are kept: the histograms are judged from MIN_WORDS words and
    MIN_CHARS characters on. Rows are judged by themselves, so repeated rows
    share their verdict. An empty table stays empty.
    """
    rows, _, kept, _ = judged(docs, text)
    return rows.where(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept for every row; see ``quality_filter`` for odd texts."""
    rows, failed, kept, column = judged(docs.select("doc_id", "text"), keep=["doc_id"])
    counts = [F.col(column)[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *counts, F.col(failed).alias("base_failed"), F.col(kept).alias("kept"))
