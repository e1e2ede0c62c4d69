"""Secrets, personal data and the pipeline."""

import hashlib
import random
import re
import string

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from survspark.llm import pii, secret_scan
from survspark.llm.common import SLICE_BYTES
from survspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(x):
    x = x or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 16])


def test_base_spans_equal_the_patterns(spark, docs):
    rng = random.Random(0)
    bits = ["token=", "Secret : ", "password\":'", "api_key=", "APIKEY=abc", "token=secret:abcdefabcdefabcdef", "AKIA", "AKIAAKIA", "é😀", " ", "\n",
            "deadbeef", "0123456789abcdef", "ABCDEFGHIJKLMNOP", "x.y=z/", "password=short", "passwd=aaaaaaaaaaaa"]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 25)))) for i in range(300)] + [(900, None), (901, ""), (901, "")]
    texts.append((902, "filler 😀 " * 8000 + "token=abcdefabcdefabcdef"))
    got = secret_scan.scan_secrets(docs([(d, t, None) for d, t in texts])).collect()
    assert sorted((r.doc_id, [tuple(s) for s in r.base]) for r in got) == sorted((d, base(t)) for d, t in texts)
    assert all({tuple(s) for s in r.base} <= {tuple(s) for s in r.spans} and list(r.spans) == sorted(r.spans) for r in got)
    assert secret_scan.scan_secrets(docs([(1, "a", None)]).where("false")).count() == 0


def test_battery_finds_random_tokens_and_leaves_words(spark, docs):
    rng = random.Random(4)
    abc = string.ascii_letters + string.digits
    keys = ["".join(rng.choice(abc) for _ in range(n)) for n in (32, 40, 48, 64) for _ in range(6)]
    plain = ["internationalizationframework", "some_long_identifier_name_here", "path/to/some/module/file_name", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
             "2024-01-01-report-for-the-board-meeting", "1111111111111111111111111111", "AbstractSingletonProxyFactoryBeanImplementation"]
    df = docs([(i, f"see {k} there", None) for i, k in enumerate(keys)] + [(100 + i, f"see {k} there", None) for i, k in enumerate(plain * 30)])
    got = {r.doc_id: [s for s in r.spans if s["kind"] == 3] for r in secret_scan.scan_secrets(df).collect()}
    assert sum(got[i] != [] and got[i][0]["start"] == 4 and got[i][0]["end"] == 4 + len(k) for i, k in enumerate(keys)) >= 0.95 * len(keys)
    assert all(not v for i, v in got.items() if i >= 100)


def test_battery_recall_by_encoding(spark, docs):
    rng = random.Random(8)
    up, low, num = string.ascii_uppercase, string.ascii_lowercase, string.digits
    least = {"lower": (low, 0.95), "upper": (up, 0.95), "letters": (up + low, 0.95), "base32": (up + "234567", 0.85), "base36": (low + num, 0.85),
             "base62": (up + low + num, 0.95), "base64": (up + low + num + "+/", 0.95), "base64url": (up + low + num + "-_", 0.95)}
    rows = [(name, n, "".join(rng.choice(abc) for _ in range(n))) for name, (abc, _) in least.items() for n in (32, 40, 64) for _ in range(25)]
    got = secret_scan.scan_secrets(docs([(i, f"see {t} there", None) for i, (_, _, t) in enumerate(rows)])).collect()
    # a base span (a run of 16 hex characters or an AKIA key) has precedence over the battery
    found = {r.doc_id for r in got if len(r.spans)}
    for name, (_, share) in least.items():
        of = [i for i, r in enumerate(rows) if r[0] == name]
        assert len(found & set(of)) >= share * len(of), (name, len(found & set(of)), len(of))


def test_secret_query_digest(spark):
    texts = pq.read_table(f"{SF}/documents.parquet").to_pandas().set_index("doc_id").text
    for r in QUERIES["op3_secrets"](spark, SF).collect():
        want = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


PEOPLE = ["ann.lee@mail.example.com", "Bob99@Mail.Example.com", "+1 (784) 555-8120", "784-555-8120", "4111 1111 1111 1111", "4195224655625070",
          "12.197.240.125", "123-45-6789", "DE89 3704 0044 0532 0130 00", "Mrs. Smith", "Herr Müller", "г-жа Иванова", "Mr John Brown"]


def test_surrogates_keep_form_and_identity(spark, docs):
    texts = [(i, f"Call {p} now, or bob99@mail.example.com.") for i, p in enumerate(PEOPLE)]
    texts += [(100, None), (101, ""), (102, "nothing at 1.2.3 or 2024-01-01 here"), (103, "word " * 9000 + PEOPLE[2]), (2, texts[2][1])]
    rows = pii.replace_pii(docs([(d, t, None) for d, t in texts]).withColumnRenamed("score", "n_pii"), "k1").collect()
    new = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) and new[100].text is None and new[102].text == texts[len(PEOPLE) + 2][1] and new[101].n_pii == 0
    found = {}
    for (d, t), p in zip(texts, PEOPLE):
        m = re.fullmatch("Call (.*) now, or (.*)\\.", new[d].text)
        found[p] = m[1]
        assert m[1] != p and p not in new[d].text and m[2].lower() == found.get(PEOPLE[1], m[2]).lower() and new[d].n_pii == 2
        if not p[0].isalpha() or p.startswith("DE"):
            assert len(m[1]) == len(p) or p == PEOPLE[6]
            assert re.sub(r"\w", "", m[1]) == re.sub(r"\w", "", p)
    assert found[PEOPLE[3]].replace("-", "") == re.sub(r"\D", "", found[PEOPLE[2]])[1:] and found[PEOPLE[2]].startswith("+1 (")
    assert found[PEOPLE[0]].endswith(".com") and found[PEOPLE[0]].split("@")[1] == found[PEOPLE[1]].split("@")[1].lower()
    assert found[PEOPLE[1]][0].isupper() and found["Mrs. Smith"].startswith("Mrs. ") and re.search("[А-Я]", found["г-жа Иванова"])
    digits = [int(c) for c in re.sub(r"\D", "", found[PEOPLE[4]])]
    assert digits[0] == 4 and (sum(digits[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in digits[-2::-2])) % 10 == 0
    assert len({v.lower() for v in found.values()}) == len(found) and found["Mr John Brown"].split()[1] in pii.GIVEN["latin", "m"]
    again = pii.replace_pii(docs([(d, t, None) for d, t in texts]), "k2").where("doc_id = 0").first().text
    assert again != new[0].text
    assert pii.replace_pii(docs([(1, "a", None)]).where("false"), "k").count() == 0


def test_taken_surrogates_are_drawn_again(spark, monkeypatch):
    first = pii.draw

    def crowded(values, key, attempt):
        out = first(values, key, attempt)
        return out if attempt else out.selectExpr("kind", "canon", "case when canon < '1.1.1.5' then '9.9.9.9' else '1.1.1.0' end as surrogate")

    monkeypatch.setattr(pii, "draw", crowded)
    values = spark.createDataFrame([("ip", f"1.1.1.{i}") for i in range(9)], "kind string, canon string")
    got = pii.surrogate_table(values, "k").collect()
    assert len(got) == 9 and len({r.surrogate for r in got}) == 9 and not {r.surrogate for r in got} & {r.canon for r in got}


def test_pipeline_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "decontaminated", "surrogates", "packed"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert 0.7 * n < len(ids) <= n
        if name == "surrogates":
            assert not any(re.search(r"@mail\d\.example\.com|\+1 \(\d+\) 555-\d{4}", r.text) for r in out.collect())
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_decide_by_row_where_ids_are_null_or_repeat(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 150").first()["text"]
    clean = " ".join(f"clean{i}" for i in range(80))
    near = clean.replace("clean40", "other")
    rows = [(None, clean), (5, near), (5, "another text of the same id"), (6, None), (None, item), (8, item + " tail"), (8, "clean row of an id that repeats"),
            (9, "one " * 3), (9, "one " * 3)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert (5, near) in kept and (None, clean) not in kept and (5, "another text of the same id") in kept and (6, None) in kept
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.decontaminated(spark, docs, SF).collect()]
    assert sorted(kept, key=repr) == sorted([r for r in rows if r[1] is None or item not in r[1]], key=repr)


def test_pipeline_hands_python_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    rows = [(i, f"{i:04d} " + "some words " * 2000, "en", "s", 22_005) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows * 22_005])], names=["bytes"])

    try:
        for _, stage in corpus_pipeline.STAGES[:3] + corpus_pipeline.STAGES[4:]:
            spark.conf.unset(key)
            stage(spark, docs.limit(2), SF)
            got = [r["bytes"] for r in docs.mapInArrow(sizes, "bytes long").collect()]
            assert sum(got) == 300 * 22_005 and max(got) <= SLICE_BYTES + 22_005
        spark.conf.set(key, "100000")  # a limit of the session stays
        corpus_pipeline.language_id(spark, docs.limit(2), SF)
        assert spark.conf.get(key) == "100000"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
