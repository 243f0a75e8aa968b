"""Text analysis: functions map columns to a column, inside the JVM; ``with_stems`` maps a table, in Arrow batches."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"

STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by "
    "for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def without_stop_words(words: Column | str, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.filter(_col(words), lambda w: ~w.isin(*stop))  # looked up in a set


def alphabetic(words: Column | str) -> Column:
    return F.filter(_col(words), lambda w: w.rlike(r"^\p{L}+$"))


def ngrams(words: Column | str, n: int = 2) -> Column:
    """Runs of n words, joined by spaces: shifted slices zipped, so that the words are made once for each slice."""
    words = _col(words)
    size = F.greatest(F.size(words) - n + 1, F.lit(0))
    out = F.slice(words, F.lit(1), size)
    for i in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(i + 1), size), lambda x, y: F.concat_ws(" ", x, y))
    return out


def sentences(text: Column | str) -> Column:
    """Cut behind end marks that white space follows; blank ones are left out."""
    marked = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def lemma(word: Column | str) -> Column:
    """A noun's singular by rule: -ies, -sses, -xes and the like, -s."""
    w = _col(word)
    return (
        F.when(w.rlike("[^aeiou]ies$"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("(ss|x|ch|sh|z)es$"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("(ss|us|is)$") | (F.length(w) < 4), w)
        .when(w.endswith("s"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def lemmas(words: Column | str) -> Column:
    return F.transform(_col(words), lemma)


# The published suffix stripper. Suffixes and what takes their place, longer ones first where one ends another.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("ousli", "ous"), ("eli", "e"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_RUN, _VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"  # of consonants, of vowels; a first y is written Y
MEASURE_0 = f"^(?:{_RUN})?{_VOWELS}{_RUN}"  #: more than 0 runs of vowels and consonants
MEASURE_1 = f"{MEASURE_0}{_VOWELS}{_RUN}"  #: more than 1
EXACTLY_1 = f"{MEASURE_0}(?:{_VOWELS})?$"
HAS_VOWEL = f"^(?:{_RUN})?[aeiouy]"
SHORT = f"^{_RUN}[aeiouy][^aeiouwxy]$"  #: consonants, a vowel, a consonant


def _less(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _replaced(w: Column, rules, measure: str) -> Column:
    """The first suffix that a word has gives way if the rest has the measure; no other is tried."""
    out = None
    for suffix, other in rules:
        rest = _less(w, len(suffix))
        value = F.when(rest.rlike(measure), F.concat(rest, F.lit(other))).otherwise(w)
        out = F.when(w.endswith(suffix), value) if out is None else out.when(w.endswith(suffix), value)
    return out.otherwise(w)


def _plural(w: Column) -> Column:
    w1 = F.when(w.startswith("y"), F.concat(F.lit("Y"), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)
    return F.when(w.rlike("(?:ss|i)es$") & (F.length(w) > 3), _less(w1, 2)).when(w.rlike("[^s]s$"), _less(w1, 1)).otherwise(w1)


def _past(w: Column) -> Column:
    """-eed, -ed and -ing; a mark stands behind what was cut."""
    cut = lambda n: F.when(_less(w, n).rlike(HAS_VOWEL), F.concat(_less(w, n), F.lit("\u0001"))).otherwise(w)
    return F.when(w.endswith("eed"), F.when(_less(w, 3).rlike(MEASURE_0), _less(w, 1)).otherwise(w)).when(w.endswith("ed"), cut(2)).when(w.endswith("ing"), cut(3)).otherwise(w)


def _mended(w: Column) -> Column:
    c = _less(w, 1)
    mended = F.when(c.rlike("(?:at|bl|iz)$") | c.rlike(SHORT), F.concat(c, F.lit("e"))).when(c.rlike(r"([^aeiouylsz])\1$"), _less(c, 1)).otherwise(c)
    return F.when(w.endswith("\u0001"), mended).otherwise(w)


def _last_y(w: Column) -> Column:
    return F.when(w.endswith("y") & _less(w, 1).rlike(HAS_VOWEL), F.concat(_less(w, 1), F.lit("i"))).otherwise(w)


def _step_4(w: Column) -> Column:
    out = None
    for suffix in STEP_4:
        rest = _less(w, len(suffix))
        fits = rest.rlike(MEASURE_1) & rest.rlike("[st]$") if suffix == "ion" else rest.rlike(MEASURE_1)
        value = F.when(fits, rest).otherwise(w)
        out = F.when(w.endswith(suffix), value) if out is None else out.when(w.endswith(suffix), value)
    return out.otherwise(w)


def _last_e(w: Column) -> Column:
    rest = _less(w, 1)
    return F.when(w.endswith("e") & (rest.rlike(MEASURE_1) | (rest.rlike(EXACTLY_1) & ~rest.rlike(SHORT))), rest).otherwise(w)


def _double_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(MEASURE_1), _less(w, 1)).otherwise(w)


def stems(words: Column | str) -> Column:
    """Lower-cased words by the published suffix stripper, all five steps; words of one or two letters stay.

    A step is a pass over the words, so that each is an expression of a word and not of all steps before.
    """
    out = _col(words)
    steps = (_plural, _past, _mended, _last_y, lambda w: _replaced(w, STEP_2, MEASURE_0), lambda w: _replaced(w, STEP_3, MEASURE_0), _step_4, _last_e, _double_l)
    for step in steps:
        out = F.transform(out, step)
    return F.zip_with(_col(words), out, lambda w, x: F.when(F.length(w) > 2, F.regexp_replace(x, "^Y", "y")).otherwise(w))


def stem(word: Column | str) -> Column:
    return stems(F.array(_col(word)))[0]


def tagged_lemmas(tagged: Column | str) -> Column:
    """Lemmas of an array of structs (word, tag): a noun's (tag N...) and a verb's by rule, other words as they are.

    The tags come from any tagger; a word without one is left out.
    """
    def by_tag(x: Column) -> Column:
        w = x["word"]
        verb = F.when(w.rlike("[^aeiou]ies$|[^aeiou]ied$"), F.concat(_less(w, 3), F.lit("y"))).when(w.rlike("(?:ss|x|ch|sh|z)es$"), _less(w, 2)).when(w.rlike("[^s]s$") & (F.length(w) > 3), _less(w, 1))
        verb = verb.when(w.rlike("[aeiouy].*ing$") | w.rlike("[aeiouy].*[^e]ed$"), _mended(F.concat(F.regexp_replace(w, "(?:ing|ed)$", ""), F.lit("\u0001")))).otherwise(w)
        return F.when(x["tag"].startswith("N"), lemma(w)).when(x["tag"].startswith("V"), verb).otherwise(w)

    return F.transform(F.filter(_col(tagged), lambda x: x["tag"].isNotNull() & (x["tag"] != "")), by_tag)


def cleaned(text: Column | str) -> Column:
    """Two arrays for each sentence: its alphabetic words that aren't stop words, then the pairs of neighbours of all its words."""
    each = F.transform(sentences(text), lambda s: F.array(without_stop_words(alphabetic(tokens(s))), ngrams(tokens(s), 2)))
    return F.flatten(each)


def with_labels(text: Column | str, labels: Column | str) -> Column:
    """A text with the labels of what was detected in its image behind it; null is empty."""
    return F.concat_ws(" ", F.coalesce(_col(text), F.lit("")), F.array_join(F.coalesce(_col(labels), F.array().cast("array<string>")), " "))


def entities(text: Column | str) -> Column:
    """Runs of two or more capitalised words."""
    return F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"(?:\p{Lu}\p{Ll}+ ?){2,}"), F.lit(0)), lambda s: F.trim(s))


def analyze(text: Column | str, stop: bool = False, lemmatize: bool = False, with_entities: bool = False) -> Column:
    """The analysis chain: tokens, then without stop words, lemmatized, with entities appended."""
    out = tokens(text)
    if stop:
        out = without_stop_words(out)
    if lemmatize:
        out = lemmas(out)
    return F.concat(out, entities(text)) if with_entities else out


def expansion(word: Column | str, synonyms: Column | str, most: int = 3) -> Column:
    """``(word s1 s2 s3)`` with the first synonyms in order, or the word alone."""
    word, found = _col(word), F.slice(F.array_sort(F.array_distinct(_col(synonyms))), 1, most)
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, F.concat(F.lit("("), F.array_join(F.concat(F.array(word), found), " "), F.lit(")"))).otherwise(word)


def snippet(text: Column | str, terms: Column | str, length: int = 30) -> Column:
    """``length`` words around the first that is a term, with ``...`` where the text goes on."""
    w, terms = F.split(F.trim(F.regexp_replace(_col(text), r"\s+", " ")), " "), _col(terms)
    at = F.nullif(F.array_position(F.transform(w, lambda x: F.array_contains(terms, F.lower(x))), True), F.lit(0)).cast("int")
    start = F.greatest(at - length // 2, F.lit(1))
    end = F.least(at + length // 2, F.size(w) + 1)  # exclusive
    cut = F.array_join(F.slice(w, start, end - start), " ")
    return F.when(at.isNull(), F.lit("No relevant snippet found.")).otherwise(F.concat(cut, F.when(end <= F.size(w), F.lit("...")).otherwise(F.lit(""))))


def document_digest(name: Column | str) -> Column:
    return F.md5(_col(name))


def combined(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *parts)


def hex_color(rgb: Column | str) -> Column:
    rgb = _col(rgb)
    return F.format_string("#%02x%02x%02x", rgb[0], rgb[1], rgb[2])


def color_of(code: Column | str) -> Column:
    """[r, g, b] of ``#rrggbb``."""
    digits = F.regexp_replace(_col(code), "^#", "")
    return F.array(*[F.conv(F.substring(digits, i, 2), 16, 10).cast("int") for i in (1, 3, 5)])


def absolute_url(base: Column | str, link: Column | str) -> Column:
    """A link resolved against a page's address: absolute, of a scheme, of a host, of a folder, a query or a fragment."""
    base, link = _col(base), F.trim(_col(link))
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    path = F.regexp_extract(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(.*)$", 1)
    folder = F.concat(origin, F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", "")))
    joined = (
        F.when(link == "", F.regexp_replace(base, r"#.*$", ""))
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(bare, link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), link))
        .otherwise(F.concat(folder, link))
    )
    return F.when(joined.rlike(r"/\.\.?(?:[/?#]|$)"), _without_dots(joined)).otherwise(joined)


def _without_dots(url: Column) -> Column:
    """An address whose path has no segments of one or two dots: two take the segment before with them."""
    origin = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    rest = F.substring(url, F.length(origin) + 1, F.length(url))
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(parts, empty, lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    last = F.element_at(parts, -1).isin(".", "..")  # a folder
    return F.concat(origin, F.lit("/"), F.array_join(F.when(last & (F.size(kept) > 0), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"), F.substring(rest, F.length(path) + 1, F.length(rest)))


_MATCHES = {p: re.compile(p).search for p in (MEASURE_0, MEASURE_1, EXACTLY_1, HAS_VOWEL, SHORT)}
_DOUBLE = re.compile(r"([^aeiouylsz])\1$").search
#: Words whose stems a task remembers.
REMEMBERED = 1 << 20


def _given_way(w: str, rules, measure: str) -> str:
    for suffix, other in rules:
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            return rest + other if _MATCHES[measure](rest) else w
    return w


def word_stem(w: str) -> str:
    """:func:`stem` of a word in Python."""
    if len(w) <= 2:
        return w
    has, short = _MATCHES[HAS_VOWEL], _MATCHES[SHORT]
    first = "Y" + w[1:] if w[0] == "y" else w
    w = first[:-2] if w.endswith(("sses", "ies")) and len(w) > 3 else first[:-1] if w[-1] == "s" and w[-2] != "s" else first
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _MATCHES[MEASURE_0](w[:-3]) else w
    elif w.endswith("ed"):
        cut = w[:-2]
    elif w.endswith("ing"):
        cut = w[:-3]
    if cut is not None and has(cut):
        w = cut + "e" if cut.endswith(("at", "bl", "iz")) or short(cut) else cut[:-1] if _DOUBLE(cut) else cut
    if w.endswith("y") and has(w[:-1]):
        w = w[:-1] + "i"
    w = _given_way(_given_way(w, STEP_2, MEASURE_0), STEP_3, MEASURE_0)
    for suffix in STEP_4:
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            w = rest if _MATCHES[MEASURE_1](rest) and (suffix != "ion" or rest.endswith(("s", "t"))) else w
            break
    if w.endswith("e") and (_MATCHES[MEASURE_1](w[:-1]) or (_MATCHES[EXACTLY_1](w[:-1]) and not short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _MATCHES[MEASURE_1](w):
        w = w[:-1]
    return "y" + w[1:] if w.startswith("Y") else w


def with_stems(docs: DataFrame, words: str = "words") -> DataFrame:
    """A table whose words are stemmed: each distinct word of a batch once, and those that a task has had before not again."""

    def run(batches):
        import pyarrow as pa

        known: dict[str, str] = {}
        for batch in batches:
            column = batch.column(words)
            found = column.flatten().dictionary_encode()
            if len(known) > REMEMBERED:
                known.clear()
            stems = []
            for w in found.dictionary.to_pylist():
                s = known.get(w)
                if s is None and w is not None:
                    s = known[w] = word_stem(w)
                stems.append(s)
            flat = pa.array(stems, pa.string()).take(found.indices)
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(column.is_null().to_numpy(zero_copy_only=False), False) if column.null_count else None)
            yield batch.set_column(batch.schema.get_field_index(words), words, pa.ListArray.from_arrays(offsets, flat))

    return docs.mapInArrow(run, docs.schema)
