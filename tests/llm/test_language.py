from lorekeep.llm import language
from lorekeep.llm.queries import QUERIES


def test_declared(spark, read):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, folder).collect()}
    docs = read(folder)
    assert len(rows) == len(docs)
    assert sum(rows[d.doc_id].language == d.lang for d in docs) > 0.98 * len(docs)
    assert all(rows[d.doc_id].accepted for d in docs)


def test_odd(spark, odd, read):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = language.identify(docs).collect()
    assert len(rows) == docs.count()
    kept = language.accepted(docs).collect()
    assert {r.text for r in kept} <= {r.text for r in read(odd) if r.text and any(c.isalpha() for c in r.text)}


def test_empty(spark, empty, small):
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    assert language.identify(docs).collect() == [] and language.accepted(docs).collect() == []


EN, FR = "the cat and the dog sat on the mat with this and that", "le chat est dans la maison avec une petite fille du bois"


def fused(spark, facts):
    """A text of one rare word, on hosts that speak one language or the other."""
    rows = [(k, (EN, FR)[k % 2], ("en", "fr")[k % 2], None) for k in range(40)] + [(100, "xq", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    hosts = [(k, ("en", "fr")[k % 2], f"{'ab'[k % 2]}{k}.x.{('com', 'fr')[k % 2]}", ("com", "fr")[k % 2]) for k in range(40)]
    provenance = spark.createDataFrame([*hosts, (100, *facts)], "doc_id long, declared string, host string, suffix string")
    return next(r for r in language.identify(docs, provenance).collect() if r.doc_id == 100)


def test_evidence(spark):
    plain = fused(spark, (None, None, None))
    assert fused(spark, ("fr", None, None)).language == "fr"
    assert fused(spark, ("en", None, None)).language == "en"
    assert fused(spark, (None, "new.fr", "fr")).language == "fr"
    assert fused(spark, (None, "a0.x.com", "com")).language == "en"
    assert fused(spark, ("fr", "b1.x.fr", "fr")).probability > max(plain.probability, 0.9)


def test_page_evidence(spark):
    rows = [("http://h.example.net/fr/825?page=2", '<!DOCTYPE html><HTML class="a" lang="fr-CA"><p>'), ("http://b.example.org/en/7.html", "<html>"),
            ("nothing", None), (None, "<html lang=en>"), ("http://c.example.net/fr/825/", "<html lang=en>")]
    got = {tuple(r) for r in language.page_evidence(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {(825, "en", "c.example.net", "net"), (7, None, "b.example.org", "org")}


def test_unknown(spark, read):
    """Texts of no known language go, clean short ones stay."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = ["Москва является столицей России и крупнейшим городом", "日本語は主に日本で使われている言語です", "Η Αθήνα είναι η πρωτεύουσα της Ελλάδας",
           "xkcd qwrt zpfgh bnmvk lkjhg ffdsp wrtzq", "Helsinki on Suomen pääkaupunki ja maan väkirikkain kunta"]
    clean = ["the cat and the dog sat on the mat", "der Hund und die Katze sind im Haus", "elle est dans la maison"]
    rows = [(10**9 + k, t, None, None, len(t)) for k, t in enumerate(odd + clean)]
    more = spark.createDataFrame(rows, docs.schema)
    got = {r.doc_id - 10**9: r.accepted for r in language.identify(docs.unionAll(more)).collect()}
    assert [got[k] for k in range(len(rows))] == [False] * len(odd) + [True] * len(clean)
