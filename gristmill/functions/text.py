"""Text as columns: tokens, classes of characters, and the heuristic criteria of transcriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages the script check applies to.
LATIN_LANGUAGES = ("pt", "en", "es", "fr", "de", "it")
#: Words too common to link a question by.
STOPWORDS = tuple(
    "a o as os um uma uns umas de do da dos das no na nos nas em por para com sem sob sobre ate até e ou mas porem porém que se como quando onde qual quais quem porque porquê "
    "eu tu ele ela nós vos vós eles elas meu minha teu tua seu sua nosso nossa este esta esse essa aquele aquela isto isso aquilo ser ter estar haver ir vir fazer é foi era são está estão tem têm ha há "
    "muito muitos muita muitas pouco poucos todo todos não nao sim já ja ainda também tambem an the of in on at to for with by from into about and or but is are was were be been being "
    "i you he she it we they this that does did have has had not yes what which who whom when where why how".split()
)
SPACE = r"[\s\x1C-\x1F\x85\p{Z}]"


def words(text: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def icu(text: Column, name: str, method: str, *args: Column | bool) -> Column:
    """A static method of ICU, which Spark ships, on a text; null stays null."""
    given = F.coalesce(text, F.lit(""))
    out = F.reflect(F.lit(f"com.ibm.icu.{name}"), F.lit(method), given, *(a if isinstance(a, Column) else F.lit(a) for a in args))
    return F.when(text.isNotNull(), out)


def nfkc(text: Column) -> Column:
    """Compatibility composition."""
    return icu(text, "text.Normalizer", "compose", True)


def nfkc_casefold(text: Column) -> Column:
    return icu(nfkc(text), "lang.UCharacter", "foldCase", True)


def ascii_fold(text: Column) -> Column:
    """Accents and whatever else isn't ASCII dropped, lower case."""
    return F.lower(F.regexp_replace(icu(text, "text.Normalizer", "decompose", True), r"[^\x00-\x7F]", ""))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of composed text."""
    return F.filter(F.split(F.regexp_replace(F.lower(nfkc(text)), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def query_tokens(text: Column, least: int = 3) -> Column:
    """Distinct word tokens of a question that aren't stopwords nor short."""
    found = F.regexp_extract_all(nfkc_casefold(text), F.lit(r"(?U)(\w+)"), F.lit(1))
    return F.filter(F.array_distinct(found), lambda w: (F.length(w) >= least) & ~w.isin(*STOPWORDS))


def count_of(text: Column, kind: str) -> Column:
    """How many characters are of a class, given as the class of all others."""
    return F.length(F.regexp_replace(text, kind, ""))


def content_length(text: Column, chars: int = 200, least_words: int = 30) -> Column:
    """0 for a text below either floor, else 1."""
    return F.when((F.length(stripped(text)) < chars) | (F.size(words(text)) < least_words), 0.0).otherwise(1.0)


def script_match(text: Column, language: Column, most: float = 0.1) -> Column:
    """How well the script fits a language of Latin letters: 1, 0.2 with more than a tenth of other letters, 0 if half is CJK."""
    alpha, latin, cjk = count_of(text, r"[^\p{L}]"), count_of(text, r"[^\p{IsLatin}]|[\x{AA}\x{BA}]"), count_of(text, r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")
    score = F.when(alpha == 0, 0.5).when(cjk / alpha > 0.5, 0.0).when((alpha - latin) / alpha > most, 0.2).otherwise(1.0)
    return F.when(language.isin(*LATIN_LANGUAGES), score).otherwise(1.0)


def content_density(n_words: Column, duration_ms: Column) -> Column:
    """1 for 30 to 300 words a minute, falling off outside; 0.5 without a duration, 0.3 for none."""
    wpm = n_words / (duration_ms / 60000.0)
    rate = F.when(wpm < 30, wpm / 30).when(wpm > 300, F.greatest(F.lit(0.0), 2 - wpm / 300)).otherwise(1.0)
    return F.when(duration_ms.isNull(), 0.5).when(duration_ms <= 0, 0.3).otherwise(rate)


def segment_quality(segments: Column) -> Column:
    """0.5 without segments; less 0.3 if over a fifth is empty, less 0.5 if five gaps in a row last a second (within 0.1)."""
    n = F.size(segments)
    empty = F.size(F.filter(segments, lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) == "")) / n
    starts = F.transform(segments, lambda s: s["start"])
    gaps = F.zip_with(F.slice(starts, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(starts, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)

    def step(acc: Column, g: Column) -> Column:
        run = F.when(F.abs(g - 1.0) <= 0.1, acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    most = F.aggregate(gaps, F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")), step, lambda acc: acc["most"])
    score = 1.0 - F.when(empty > 0.2, 0.3).otherwise(0.0) - F.when(most >= 5, 0.5).otherwise(0.0)
    return F.when(segments.isNull() | (n == 0), 0.5).otherwise(F.greatest(F.lit(0.0), score))


def most_equal(values: Column) -> Column:
    """How often the most frequent element of an array of numbers is in it."""

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x == acc["last"], acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    return F.aggregate(F.sort_array(values), start, step, lambda acc: acc["most"])


def repetition(text: Column) -> Column:
    """1 less the worst share of the top word (if over 0.15) or of a 3- to 5-gram that occurs four times; 0.7 for fewer than five words.

    N-grams are compared by 64-bit hashes within the row: no shuffle. A null text is null.
    """

    def score(w: Column) -> Column:
        n = F.size(w)

        def grams(k: int) -> Column:
            each = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(k))))
            return most_equal(each) / n.cast("double")

        top = F.transform(F.array(most_equal(w) / n.cast("double")), lambda x: F.when(x > 0.15, x).otherwise(0.0))
        more = F.transform(F.array(*(F.struct(F.lit(k).alias("k"), grams(k).alias("share")) for k in (3, 4, 5))), lambda x: F.when(x["share"] * n >= 3.5, x["share"] * x["k"]).otherwise(0.0))
        worst = F.array_max(F.concat(top, more))
        return F.when(n < 5, 0.7).otherwise(F.greatest(F.lit(0.0), 1 - worst))

    # the words' hashes are an element of an array here, so that they are computed once and not for each n-gram
    hashes = F.transform(words(F.lower(text)), lambda x: F.xxhash64(x))
    return F.when(text.isNotNull(), F.element_at(F.transform(F.array(hashes), score), 1))


def estimate_tokens(text: Column) -> Column:
    """A third of the characters, one at least; 0 for an empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 3).cast("int")))
