"""Surrogates: one entity one replacement, different ones different, in the mention's own format."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from millrace.llm import surrogates


def run(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in surrogates.with_surrogates(docs, "k").orderBy("doc_id").collect()]


def digits(text):
    return re.sub(r"\D", "", text)


def test_a_number_is_one_entity_in_all_its_spellings(spark):
    out = run(spark, "+1 (988) 555-2485", "+1 988 555 2485", "4111111111111111", "4111-1111-1111-1111", "4111 1111 1111 1111", "1234567890123456")
    assert digits(out[0]) == digits(out[1]) != "19885552485" and out[0].startswith("+1 (") and out[1].startswith("+1 ")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[0]) and re.fullmatch(r"\+1 \d{3} \d{3} \d{4}", out[1])
    assert digits(out[2]) == digits(out[3]) == digits(out[4]) and re.fullmatch(r"\d{4}-\d{4}-\d{4}-\d{4}", out[3])
    total = sum(sum(divmod(int(c) * (2 if k % 2 == 0 else 1), 10)) for k, c in enumerate(out[2]))
    assert total % 10 == 0
    assert re.fullmatch(r"\d{16}", out[5]) and out[5] != "1234567890123456"


def test_names_share_their_parts(spark):
    out = run(spark, "Mrs. Anna Smith, Mrs. Smith and Mr. John Smith", "then John Smith came; Anna Smith left. John Smithson stayed", "г-н Иванов и г-жа Иванова", "New York")
    first = re.fullmatch(r"Mrs\. (\w+) (\w+), Mrs\. (\w+) and Mr\. (\w+) (\w+)", out[0])
    anna, smith_f, again, john, smith_m = first.groups()
    assert smith_f == again and smith_f == smith_m[:-1] + "na" and anna.endswith("a")
    assert out[1] == f"then {john} {smith_m} came; {anna} {smith_f} left. John Smithson stayed"
    a, b = re.fullmatch(r"г-н (\w+) и г-жа (\w+)", out[2]).groups()
    assert b == a + "а" and re.fullmatch(r"[А-я]+", a)
    assert out[3] == "New York"


def test_addresses_share_their_domain(spark):
    out = run(spark, "x.yz@corp.example", "ab@CORP.example", "x.yz@other.example", "X.YZ@corp.example")
    boxes, domains = zip(*[t.split("@") for t in out], strict=True)
    assert domains[0] == domains[1] == domains[3] != domains[2] and domains[0] != "corp.example"
    assert out[0] == out[3] and boxes[0] != boxes[1]
    assert all(d.endswith(".example") for d in domains)


def test_secrets_keep_their_label(spark):
    out = run(spark, "password=hunter2x9", 'TOKEN = "0123456789abcdef"', "pwd: letmein99", "password: forgotten", "api_key=AbC-123456")
    assert re.fullmatch(r"password=[a-z]{6}\d[a-z]\d", out[0]) and out[0] != "password=hunter2x9"
    assert re.fullmatch(r'TOKEN = "[0-9a-f]{16}"', out[1]) and "0123456789abcdef" not in out[1]
    assert re.fullmatch(r"pwd: [a-z]{7}\d\d", out[2]) and out[3] == "password: forgotten"
    assert re.fullmatch(r"api_key=[A-Z][a-z][A-Z]-\d{6}", out[4])


def test_small_pools_do_not_run_out(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.chr(97 + F.col("id") % 26), F.when(F.col("id") >= 26, F.chr(97 + (F.col("id") / 26).cast("int") % 26)).otherwise(F.lit("")), F.lit("@one.example")).alias("text"))
    out = [r.text for r in surrogates.with_surrogates(docs, "k").collect()]
    assert len(set(out)) == docs.select("text").distinct().count()


def test_distinct_and_coreferent_over_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in surrogates.with_surrogates(docs, "k").collect()}
    there: dict[tuple, set] = {}
    back: dict[tuple, set] = {}
    for r in docs.collect():
        text, kinds = r.text or "", ("email", "phone", "id", "ip", "key")
        after = out[r.doc_id].text or ""
        for kind in kinds:
            rx = re.compile(surrogates.PATTERNS[kind])
            a, b = rx.findall(text), rx.findall(after)
            assert len(a) == len(b), (r.doc_id, kind)
            for x, y in zip(a, b, strict=True):
                canon = x.lower() if kind == "email" else digits(x) if kind in ("phone", "id") else x
                shown = digits(y) if kind in ("phone", "id") else y
                there.setdefault((kind, canon), set()).add(shown)
                back.setdefault((kind, shown), set()).add(canon)
    assert there and all(len(v) == 1 for v in there.values()) and all(len(v) == 1 for v in back.values())
    assert not {k for k in there} & {k for k in back}
    assert sum(r.n_entities for r in out.values()) > 100


def test_titles_hyphens_apostrophes_and_particles(spark):
    out = run(spark, "Dr. Anna Smith wrote. Contact Anna Smith, or Smith's office.", "Prof. Dr. Ivan Petrov", "Herr Jean-Luc Picard left", "Mr. O'Brien and Mrs. O'Brien-Smith", "Frau Müller und Müller", "Herr Ludwig van Beethoven", "Sra. de la Cruz", "Smith alone")
    given, sur = re.match(r"Dr\. (\w+) (\w+) wrote", out[0]).groups()
    assert out[0] == f"Dr. {given} {sur} wrote. Contact {given} {sur}, or {sur}'s office." and "Smith" not in out[0] and "Anna" not in out[0]
    assert re.fullmatch(r"Prof\. Dr\. \w+ \w+", out[1]) and not {"Ivan", "Petrov"} & set(out[1].split())
    assert re.fullmatch(r"Herr \p{Lu}\w+-\p{Lu}\w+ \w+ left".replace(r"\p{Lu}", "[A-Z]"), out[2]) and not re.search("Jean|Luc|Picard", out[2])
    assert re.fullmatch(r"Mr\. O'[A-Z]\w+ and Mrs\. O'[A-Z]\w+-[A-Z]\w+", out[3]) and not re.search("Brien|Smith", out[3])
    a, b = re.fullmatch(r"Frau (\w+) und (\w+)", out[4]).groups()
    assert a == b != "Müller"
    assert re.fullmatch(r"Herr \w+ van \w+", out[5]) and not re.search("Ludwig|Beethoven", out[5])
    assert re.fullmatch(r"Sra\. de la \w+", out[6]) and "Cruz" not in out[6]
    assert out[7] == "Smith alone"


def test_national_phones_ibans_and_long_addresses(spark):
    texts = ["call 555-123-4567 now", "(212) 555 0187", "212.555.0187", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80:1:2::8a2e:370", "std::vector and a::b", "10:20:30", "123-456-78901", "1234-555-123-4567"]
    out = run(spark, *texts)
    assert re.fullmatch(r"call \d{3}-\d{3}-\d{4} now", out[0]) and re.fullmatch(r"\(\d{3}\) \d{3} \d{4}", out[1]) and re.fullmatch(r"\d{3}\.\d{3}\.\d{4}", out[2])
    assert digits(out[1]) == digits(out[2]) != "2125550187" and out[0] != texts[0]
    assert out[3].replace(" ", "") == out[4] != texts[4] and re.fullmatch(r"DE\d{2}( \d{4}){4} \d{2}", out[3])
    assert re.fullmatch(r"([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}", out[5]) and out[5] != texts[5] and re.fullmatch(r"[a-f]{2}\d{2}:\d:\d::\d[a-f]\d[a-f]:\d{3}", out[6])
    assert out[7:] == texts[7:]
