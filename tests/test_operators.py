"""Golden cases of the table operators."""

from pyspark.sql import functions as F

from maskwright.operators import detect, enrich, mask, match, merge, replace, report, review, sessions, validate, verify
from maskwright.plans import jobs
from maskwright.sources import documents, files, responses


def words(spark, *texts):
    return documents.words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_dictionary_match(spark):
    w = words(spark, "John  Smith met john\tsmith and JOHN", "Johnny Smith", "")
    d = spark.createDataFrame([("John Smith",), ("john",), ("absent",), (" ",)], "entity_text string")
    got = sorted((r.doc_id, r.word_idx, r.entity_text) for r in match.match_dictionary(w, d).collect())
    assert got == [(0, 0, "John Smith"), (0, 0, "john"), (0, 3, "John Smith"), (0, 3, "john"), (0, 6, "john")]


def test_entity_boxes_keep_unmatched(spark):
    w = words(spark, "John Smith here")
    e = spark.createDataFrame([(0, "a", "john smith"), (0, "b", "nobody")], "doc_id long, entity_id string, original_text string")
    got = {r.entity_id: r.matches for r in match.entity_boxes(w, e).collect()}
    assert len(got["a"]) == 1 and len(got["a"][0].bounding_boxes) == 1 and got["b"] == []


def test_labels(spark):
    e = spark.createDataFrame([(1, 0, "Full Name", "John Smith"), (1, 1, "Full Name", "Jane Doe"), (2, 0, "Full Name", "Bob"), (2, 1, "Alias", "bob "), (2, 2, "Alias", "Zed")], "doc_id long, ent_idx int, entity_type string, original_text string")
    got = {(r.doc_id, r.ent_idx): r.label for r in enrich.with_labels(e).collect()}
    assert got == {(1, 0): "Full_Name_A", (1, 1): "Full_Name_B", (2, 0): "Full_Name_A", (2, 1): "Full_Name_A", (2, 2): "Alias_A"}


def test_fakes_are_consistent_in_a_document(spark):
    e = spark.createDataFrame([(1, 0, "Full Name", "John Smith"), (1, 1, "Alias", " john smith"), (2, 0, "Full Name", "John Smith")], "doc_id long, ent_idx int, entity_type string, original_text string")
    got = {(r.doc_id, r.ent_idx): r.fake for r in enrich.with_fakes(e, "s").collect()}
    assert got[1, 0] == got[1, 1] and got == {(r.doc_id, r.ent_idx): r.fake for r in enrich.with_fakes(e.repartition(3), "s").collect()}


def test_variant_merge(spark):
    names = ["John Doe", "Mr Doe", "Doe", "Mr", "john  doe", "Jane Roe", "Professor Doe", "John Michael Doe"]
    e = spark.createDataFrame([(1, "Full Name", i, n) for i, n in enumerate(names)], "doc_id long, entity_type string, ent_idx int, original_text string")
    groups = {}
    for r in merge.variant_roots(e).collect():
        groups.setdefault(names[r.root_idx], set()).add(names[r.ent_idx])
    assert groups == {"John Michael Doe": {"John Michael Doe", "Doe"}, "Professor Doe": {"Professor Doe", "Mr Doe"}, "john  doe": {"john  doe", "John Doe"}, "Jane Roe": {"Jane Roe"}, "Mr": {"Mr"}}
    assert merge.oversized_groups(e, 3).count() == 1 and merge.variant_roots(e, 3).count() == 0


def test_merge_keeps_uncovered_occurrences(spark):
    occ = "array<struct<page_number:int,original_text:string,bounding_boxes:array<array<double>>>>"
    rows = [(1, "Full Name", 0, "John Doe", [(1, "John Doe", [[0.1, 0.1, 0.4, 0.1]])]), (1, "Full Name", 1, "Doe", [(1, "Doe", [[0.3, 0.1, 0.2, 0.1]]), (2, "Doe", [[0.3, 0.1, 0.2, 0.1]])])]
    e = spark.createDataFrame(rows, f"doc_id long, entity_type string, ent_idx int, original_text string, occurrences {occ}")
    got = merge.merge_variants(e).collect()
    assert len(got) == 1 and [(o.page_number, o.original_text) for o in got[0].occurrences] == [(1, "John Doe"), (2, "Doe")]


def test_partial_replacements(spark):
    cases = [("John Smith", "Jane Doe", "John", "Jane"), ("John Michael Smith", "Jane Alice Doe", "John Michael", "Jane Alice"), ("John Michael Smith", "Jane Alice Doe", "Michael Smith", "Alice Doe"), ("John Doe", "Jane Smith", "Mr Doe", "Mr Smith"), ("John Doe", "Jane Smith", "Other", "Jane Smith"), ("John Doe", "Jane Smith", "john  doe", "Jane Smith")]
    df = spark.createDataFrame(cases, "e string, r string, o string, want string")
    for r in df.select("*", replace.occurrence_replacement(F.col("e"), F.col("r"), F.col("o")).alias("got")).collect():
        assert r.got == r.want, r


def test_partial_replacement_cuts_each_text_once(spark):
    # Words of the entity, the occurrence and the replacement, and the occurrence's own spelling.
    assert str(replace.occurrence_replacement(F.col("e"), F.col("r"), F.col("o"))).count("split(") == 4
    none = spark.createDataFrame([(None, "Jane Doe", "John"), ("John Doe", None, "John"), ("John Doe", "Jane", None), ("", "", "")], "e string, r string, o string")
    assert [r[0] for r in none.select(replace.occurrence_replacement(F.col("e"), F.col("r"), F.col("o"))).collect()] == ["Jane Doe", None, "Jane", ""]


def test_fakes_of_wanted_entities(spark):
    e = spark.createDataFrame([(1, "Full Name", 0, "Ann Lee"), (1, "Full Name", 1, "ANN LEE"), (1, "Full Name", 2, "Bo"), (2, "Full Name", 1, "Ann Lee")], "doc_id long, entity_type string, ent_idx int, original_text string")
    every = {(r.doc_id, r.ent_idx): r.fake for r in enrich.with_fakes(e, "s").collect()}
    got = {(r.doc_id, r.ent_idx): r.fake for r in enrich.with_fakes(e, "s", wanted=e.where("ent_idx = 1").select("doc_id", "ent_idx").limit(2)).collect()}
    # The one asked for takes the spelling that was seen first, though that one isn't asked for.
    assert got == {k: every[k] for k in ((1, 1), (2, 1))}


def test_component_alignment(spark):
    def align(original, replacement, *fields):
        rows = [(1, "o", original, replacement, i, float(x), 0.0, v) for i, (x, v) in enumerate(fields)]
        df = spark.createDataFrame(rows, "doc_id long, occ_id string, original string, replacement string, field_id int, x0 double, y0 double, value string")
        return [r.new_value for r in replace.align_components(df).orderBy("field_id").collect()]

    assert align("15/03/1985", "22/07/1985", (1, "15"), (2, "03"), (3, "1985")) == ["22", "07", "1985"]
    assert align("2023 45678 1", "9876 54321 0", (1, "2023"), (2, "45678")) == ["9876", "54321"]
    assert align("01/01/2025", "05/03/2025", (50, "01"), (100, "01")) == ["05", "03"]
    assert align("2023456781", "9876543210", *[(i, c) for i, c in enumerate("2023456781")]) == list("9876543210")
    assert align("80 Ann St", "99 Fake Road North", (1, "Ann")) == ["99 Fake Road North"]


def test_span_masking(spark):
    span = "array<struct<start:int,length:int,replacement:string>>"
    rows = [("abcdef", [(1, 2, "X"), (4, 1, "Y")], "aXdYf"), ("abcdef", [(0, 4, "X"), (1, 2, "Y")], "Xef"), ("abcdef", [(0, 3, "X"), (2, 3, "Y")], "Xf"), ("abc", [], "abc"), ("abab", [(0, 2, "ab"), (2, 2, "-")], "ab-")]
    df = spark.createDataFrame(rows, f"t string, s {span}, want string")
    for r in df.select("want", mask.mask_spans(F.col("t"), F.col("s")).alias("got")).collect():
        assert r.got == r.want


def test_word_masking(spark):
    w = words(spark, "my John Smith is")
    hits = spark.createDataFrame([(0, 1, 1, 2, "Jane Doe"), (0, 1, 2, 1, "Doe")], "doc_id long, page_number int, word_idx int, n int, replacement string")
    assert mask.mask_words(w, hits).first().masked_text == "my Jane Doe is"


def test_verification(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    occ = spark.createDataFrame([(1, 1, "Al"), (1, 1, "Bo"), (1, 2, "Cy"), (2, 1, "Dee")], "doc_id long, page_number int, original_text string")
    pages = spark.createDataFrame([(1, 1, "also x"), (2, 1, "dee")], "doc_id long, page_number int, masked_text string")
    got = {r.doc_id: r for r in verify.score(docs, verify.check_occurrences(occ, pages)).collect()}
    assert (got[1].occurrences_total, got[1].occurrences_masked, got[1].occurrences_unverifiable, got[1].score, got[1].remaining) == (3, 2, 1, 66.7, "p1:'Al'")
    assert (got[2].score, got[2].verdict) == (0.0, "Masking incomplete") and (got[3].score, got[3].verdict) == (100.0, "No entities found")
    words_only = verify.check_occurrences(occ, pages, whole_words=True).where("original_text = 'Al'").first()
    assert words_only.masked


def test_response_parsing(spark):
    good = '```json\n[{"entity_type":"Name","original_text":"A B","occurrences":[{"page_number":2,"bounding_boxes":[[0.1,0.2,0.1,0.1],[0.3,0.208,0.1,0.1]]}]},{"entity_type":"","original_text":"x","occurrences":[]}]\n```'
    dicts = '[{"entity_type":"Name","original_text":"C","confidence":0.5,"occurrences":[{"original_text":"c","bounding_boxes":[{"x":0.1,"y":0.2,"width":0.1,"height":0.1},[1]]}]}]'
    df = spark.createDataFrame([(1, 1, good), (2, 1, dicts), (3, 1, "oops"), (3, 2, dicts), (4, 1, "[]")], "doc_id long, page_number int, response_text string")
    entities, errors = responses.parse_responses(df)
    got = {r.doc_id: r for r in entities.collect()}
    assert set(got) == {1, 2} and [r.doc_id for r in errors.collect()] == [3]
    assert got[1].confidence == 0.9 and got[1].occurrences[0].original_text == "A B" and len(got[1].occurrences[0].bounding_boxes) == 1
    assert got[2].occurrences[0].page_number == 1 and got[2].confidence == 0.5
    assert {r.doc_id for r in responses.parse_responses(df, "skip_page")[0].collect()} == {1, 2, 3}


def test_envelopes(spark):
    e = '{"id":"1","entity_type":"Name","original_text":"A","occurrences":[]}'
    rows = [(1, '{"predictions":[{"pages":[{"page_number":1,"entities":[%s]}]}]}' % e), (2, '{"dataframe_records":[{"entities":[%s]}]}' % e), (3, '{"entities":[%s,%s]}' % (e, e)), (4, '{"predictions":[{"status":"error"}]}'), (5, "nonsense")]
    good, bad = responses.parse_envelopes(spark.createDataFrame(rows, "doc_id long, response string"))
    assert sorted((r.doc_id, r.ent_idx) for r in good.collect()) == [(1, 0), (2, 0), (3, 0), (3, 1)]
    assert {r.doc_id: r.error for r in bad.collect()} == {4: "Unknown error", 5: "Unknown error"}


def test_configs_and_fields(spark):
    df = spark.createDataFrame([("a", '{"field_definitions":[{"name":" N ","description":"d"},{"name":"","description":"d"}]}'), ("b", '[{"name":"X","description":"y","strategy":"redact"}]'), ("c", "[]")], "config_key string, value string")
    f = files.parse_configs(df)
    assert {r.config_key for r in f.where("error is not null").collect()} == {"c"}
    clean = validate.clean_fields(f.where("error is null"))
    assert sorted((r.name, r.strategy) for r in clean.collect()) == [("N", "Fake Data"), ("X", "redact")]
    assert [r.error for r in validate.field_errors(f.where("error is null")).collect()] == ["blank name"]


def test_ocr_words(spark):
    raw = '{"doc_id":"d","analyzeResult":{"pages":[{"pageNumber":1,"width":10,"height":20,"words":[{"content":"hi","polygon":[1,2,3,2,3,4,1,4]}]}]}}'
    df = spark.read.schema(f"doc_id string, {files.OCR}").json(spark.sparkContext.parallelize([raw]))
    r = files.ocr_words(df).first()
    assert (r.text, r.confidence, [round(v, 6) for v in r.box]) == ("hi", 0.0, [0.1, 0.1, 0.2, 0.1])


def test_file_checks_and_review(spark):
    f = spark.createDataFrame([("a.pdf", 5), ("b.TXT", 5), ("c.docx", 10 * 1024 * 1024 + 1), ("noext", 1)], "filename string, length long")
    assert [r.reject_reason is None for r in validate.check_files(f).orderBy("filename").collect()] == [True, False, False, False]
    e = spark.createDataFrame([(1, "x", None, True), (1, "y", "old", False)], "doc_id long, entity_id string, replacement_text string, approved boolean")
    edits = spark.createDataFrame([(1, "y", 0, "one"), (1, "y", 1, "two")], "doc_id long, entity_id string, pos int, replacement_text string")
    assert {r.entity_id: r.replacement_text for r in review.with_edits(e, edits).collect()} == {"x": None, "y": "two"}
    assert [r.entity_id for r in review.approved(e).collect()] == ["x"]


def test_sessions_and_reports(spark):
    ev = spark.createDataFrame([("a", "uploaded", None, 1), ("a", "processing", None, 2), ("b", "processing", None, 1), ("b", "completed", None, 9)], "session_id string, status string, error_message string, t int").withColumn("at", F.timestamp_seconds(F.col("t") * 1000)).drop("t")
    assert {r.session_id: r.status for r in sessions.current_state(ev).collect()} == {"a": "processing", "b": "completed"}
    assert [r.session_id for r in sessions.timed_out(ev, F.timestamp_seconds(F.lit(4000))).collect()] == ["a"]
    res = spark.createDataFrame([("error", None), ("completed", "Excellent")], "status string, verdict string")
    assert report.batch_banner(res).first().asDict() == {"level": "warning", "done": 1, "total": 2}


def test_extractors(spark):
    d = spark.createDataFrame([(1, "mail a@b.com now"), (2, None), (3, "boom")], "doc_id long, text string")
    assert [(r.original_text, r.start) for r in jobs.extract_entities(d).collect()] == [("a@b.com", 5)]

    def find(t):
        if t == "boom":
            raise ValueError("bad text")
        return [("Word", t[:4], 0, 4)] if t else []

    got = {r.doc_id: r.error for r in jobs.extract_with(d, find).collect()}
    assert got == {1: None, 3: "bad text"}


def test_deidentify_leaves_nothing(spark):
    d = spark.createDataFrame([(1, "a@b.com and A@B.com, +1 (555) 123-4567"), (2, ""), (3, "nothing")], "doc_id long, text string")
    entities, masked, scores = jobs.deidentify(d, salt="s", strategies={"Email": "Fake Data", "Phone": "Entity Label"})
    assert entities.count() == 2
    text = {r.doc_id: r.masked_text for r in masked.collect()}
    assert "[Phone_A]" in text[1] and "b.com" not in text[1].lower() and text[3] == "nothing"
    assert {r.doc_id: r.score for r in scores.collect()} == {1: 100.0, 2: 100.0, 3: 100.0}


def test_detect_positions(spark):
    d = spark.createDataFrame([(1, "1.2.3.4 x 1.2.3.4")], "doc_id long, text string")
    assert sorted((r.start, r.length) for r in detect.detect(d, patterns={"IP": detect.PATTERNS["IP"]}).collect()) == [(0, 7), (10, 7)]


def test_large_groups_merge_as_small_ones(spark):
    import random

    rng = random.Random(2)
    pick = lambda: " ".join(rng.choice(["Mr", "Dr.", "Sir", "john", "Doe", "roe", "ann"]) for _ in range(rng.randint(1, 4)))
    rows = [(d, "Full Name", i, pick()) for d in range(3) for i in range(30 + 60 * d)] + [(2, "Full Name", 900, " ")]
    e = spark.createDataFrame(rows, "doc_id long, entity_type string, ent_idx int, original_text string")
    key = lambda df: sorted(map(tuple, df.select("doc_id", "entity_type", "ent_idx", "root_idx").collect()))
    want = key(merge.variant_roots(e))
    assert key(merge.variant_roots(e, fold_up_to=50)) == want and len(want) == len(rows)


def test_groups_above_the_limit_are_kept(spark):
    e = spark.range(merge.MAX_ENTITIES + 1).select(F.lit(1).alias("doc_id"), F.lit("Full Name").alias("entity_type"), F.col("id").cast("int").alias("ent_idx"), F.concat(F.lit("name"), "id").alias("original_text"))
    assert merge.variant_roots(e).where("ent_idx = root_idx").count() == merge.MAX_ENTITIES + 1


def test_long_dictionary_entries(spark):
    said = [f"w{i % 5}" for i in range(30)]
    w = words(spark, " ".join(["x", *said, "y", *said[:20]]), " ".join(said[:29]))
    texts = [" ".join(said), " ".join(said[:13]), " ".join([*said, "z"]), "x w0"]
    d = spark.createDataFrame([(t,) for t in texts], "entity_text string")
    pages = {i: p.split() for i, p in enumerate([" ".join(["x", *said, "y", *said[:20]]), " ".join(said[:29])])}
    want = sorted((i, at, t) for i, p in pages.items() for t in texts for at in range(len(p)) if p[at : at + len(t.split())] == t.split())
    assert sorted((r.doc_id, r.word_idx, r.entity_text) for r in match.match_dictionary(w, d).collect()) == want
    only = match.match_dictionary(w, d.where("entity_text <> 'x w0'"), bbox="bbox")
    assert {len(r.boxes) for r in only.collect()} == {13, 30}
    e = spark.createDataFrame([(0, "a", texts[0]), (1, "b", texts[0])], "doc_id long, entity_id string, original_text string")
    assert {r.entity_id: len(r.matches) for r in match.entity_boxes(w, e).collect()} == {"a": 1, "b": 0}


def _rectangles(spark, seed, n):
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, w, h = rng.uniform(-1, 1), rng.uniform(-1, 1), rng.choice((0, 0.01, 0.1, 2)) * rng.random(), rng.choice((0.01, 0.1, 3)) * rng.random()
        rows.append((1, i % 2 or None, i, rng.choice(("Ann", "an", "Joanna", "", "x y", "y z", None)), x, y, x + w, y + h if i % 17 else y - h))
    # Grid lines, equal rectangles, and far away ones.
    rows += [(1, 1, n + k, "Ann", float(k % 3), 0.0, float(k % 3 + 1), 1.0) for k in range(6)] + [(1, 1, n + 6, "far", 1e9, 1e9, 3e9, 1e9 + 1), (1, 1, n + 7, None, None, 0.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, page_number int, occ_id long, original string, x0 double, y0 double, x1 double, y1 double")


def test_touching_boxes_equal_all_pairs(spark):
    b, o = _rectangles(spark, 1, 150), _rectangles(spark, 2, 170)
    got = sorted((r.b.occ_id, r.o.occ_id) for r in replace.touching_boxes(b, o).collect())
    meet = lambda p, q: p.page_number == q.page_number == 1 and None not in (p.x0, q.x0) and max(p.x0, q.x0) < min(p.x1, q.x1) and max(p.y0, q.y0) < min(p.y1, q.y1)
    want = sorted((p.occ_id, q.occ_id) for p in b.collect() for q in o.collect() if meet(p, q))
    assert len(want) > 300 and got == want
    assert replace.touching_boxes(b.limit(0), o).count() == 0


def test_fields_for_boxes_equal_all_pairs(spark):
    b = _rectangles(spark, 3, 60)
    f = _rectangles(spark, 4, 50).selectExpr("doc_id", "page_number", "concat('f', occ_id) field_name", "original field_value", "x0", "y0", "x1", "y1").where("x1 < 0.5")
    got = sorted((r.occ_id, r.field_name, r.found_by) for r in replace.fields_for_boxes(b, f).collect())
    want = []
    fields = f.collect()
    for p in b.collect():
        near = [q for q in fields if p.page_number == q.page_number == 1]
        hit = [q for q in near if p.x0 is not None and max(p.x0, q.x0) < min(p.x1, q.x1) and max(p.y0, q.y0) < min(p.y1, q.y1)]
        want += [(p.occ_id, q.field_name, "box") for q in hit]
        if not hit and p.original:
            t = p.original.lower()
            want += [(p.occ_id, q.field_name, "value") for q in near if q.field_value and (t in q.field_value.lower() or q.field_value.lower() in t)]
    assert {w for *_, w in want} == {"box", "value"} and got == sorted(want)


def test_crowded_page_makes_no_all_pairs(spark):
    b = spark.range(10_000).selectExpr("1L doc_id", "1 page_number", "id occ_id", "(id % 100) * 1.0D x0", "floor(id / 100) * 1.0D y0", "(id % 100) + 0.9D x1", "floor(id / 100) + 0.9D y1")
    out = replace.touching_boxes(b, b)
    assert out.count() == 10_000 and out.where("b.occ_id <> o.occ_id").count() == 0


def test_dictionary_extractor_moves_no_words(spark):
    docs = spark.createDataFrame([(1, "the Quick fox saw the quick  fox " + "w " * 100 + "fox the"), (2, None), (3, "Fox")], "doc_id long, text string")
    entries = spark.createDataFrame([("Animal", "fox"), ("Animal", "the quick"), ("None", " ")], "entity_type string, entity_text string")
    found = jobs.extract_entities(docs, "dictionary", dictionary=entries)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Generate" not in plan
    hits = match.match_dictionary(documents.words(docs), entries).selectExpr("doc_id", "page_number", "entity_type", "gram", "word_idx", "n")
    assert found.columns == ["doc_id", "page_number", "entity_type", "original_text", "start", "length"]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, hits.collect())) != []
