import pytest
from pyspark.sql import functions as F

from seamount.functions import text as T


def one(spark, value, column, **others):
    row = spark.createDataFrame([(value, *others.values())], "text string" + "".join(f", {k} array<string>" for k in others))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("value,want", [("The cats, 3 dögs!", ["the", "cats", "3", "dögs"]), ("", []), (None, []), ("--", [])])
def test_tokens(spark, value, want):
    assert one(spark, value, T.tokens("text")) == want


def test_chain(spark):
    assert one(spark, "The cats ran", T.analyze("text", stop=True, lemmatize=True)) == ["cat", "ran"]
    assert one(spark, "We met Ada Byron there", T.analyze("text", with_entities=True))[-1] == "Ada Byron"
    assert one(spark, "a b c", T.ngrams(T.tokens("text"), 2)) == ["a b", "b c"]
    assert one(spark, "a b c", T.ngrams(T.tokens("text"), 3)) == ["a b c"]
    assert one(spark, "a", T.ngrams(T.tokens("text"), 2)) == []


def test_sentences_keep_their_digits(spark):
    assert one(spark, "0 is it. 1 is next! 2 ends 2", T.sentences("text")) == ["0 is it.", "1 is next!", "2 ends 2"]
    assert one(spark, None, T.sentences("text")) == []


@pytest.mark.parametrize("word,lemma,stem", [("cities", "city", "citi"), ("boxes", "box", "box"), ("cats", "cat", "cat"), ("bus", "bus", "bu"), ("hopping", "hopping", "hop"), ("plastered", "plastered", "plaster"), ("happy", "happy", "happi")])
def test_word_forms(spark, word, lemma, stem):
    assert one(spark, word, T.lemma("text")) == lemma
    assert one(spark, word, T.stem("text")) == stem


def test_snippet(spark):
    words = [f"w{i}" for i in range(60)]
    assert one(spark, " ".join(words), T.snippet("text", "terms"), terms=["w40"]) == " ".join(words[25:55]) + "..."
    assert one(spark, " ".join(words), T.snippet("text", "terms"), terms=["w2"]) == " ".join(words[:17]) + "..."
    assert one(spark, "Abc def", T.snippet("text", "terms"), terms=["abc"]) == "Abc def"
    assert one(spark, "abc", T.snippet("text", "terms"), terms=["x"]) == "No relevant snippet found."


def test_expansion_and_colors(spark):
    assert one(spark, "red", T.expansion("text", "s"), s=["d", "b", "c", "a"]) == "(red a b c)"
    assert one(spark, "red", T.expansion("text", "s"), s=[]) == "red"
    assert one(spark, "#0aff10", T.color_of("text")) == [10, 255, 16]
    assert one(spark, "#0aff10", T.hex_color(T.color_of("text"))) == "#0aff10"


@pytest.mark.parametrize("link,want", [("/a", "http://h/a"), ("a", "http://h/d/a"), ("//x/y", "http://x/y"), ("?q", "http://h/d/e?q"), ("#f", "http://h/d/e?p#f"), ("https://o", "https://o"), ("", "http://h/d/e?p"), ("./b", "http://h/d/b")])
def test_absolute_url(spark, link, want):
    assert one(spark, link, T.absolute_url(F.lit("http://h/d/e?p#g"), "text")) == want


# Words of the published description of the stemmer
STEMS = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform
radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow
inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog
communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
yes ye youth youth by by aed a generalizations gener oscillators oscil""".split()


def test_stems(spark):
    words, want = STEMS[::2], STEMS[1::2]
    assert spark.createDataFrame([(words,)], "w array<string>").select(T.stems("w")).first()[0] == want
    assert spark.createDataFrame([(None,), ([],)], "w array<string>").select(T.stems("w").alias("s")).collect()[1].s == []


def test_tagged_cleaned_labels(spark):
    row = spark.createDataFrame([([("cities", "NNS"), ("running", "VBG"), ("hoped", "VBD"), ("carries", "VBZ"), ("better", "JJR"), ("lost", None)],)], "t array<struct<word string, tag string>>")
    assert row.select(T.tagged_lemmas("t")).first()[0] == ["city", "run", "hope", "carry", "better"]
    got = spark.createDataFrame([("The red fox. It has 2!",), (None,)], "t string").select(T.cleaned("t").alias("c")).collect()
    assert got[0].c == [["red", "fox"], ["the red", "red fox"], [], ["it has", "has 2"]] and got[1].c == []
    labels = spark.createDataFrame([("a", ["x", "y"]), (None, None), ("b", [])], "t string, l array<string>").select(T.with_labels("t", "l").alias("w")).collect()
    assert [r.w for r in labels] == ["a x y", " ", "b "]
