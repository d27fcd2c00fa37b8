"""Evidence, fusion, correction, layout, exports and streaming on small boards."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from pinwall import pipeline
from pinwall.functions import similarity as S
from pinwall.operators import boards, correction, evidence, fold, fusion, layout
from pinwall.sources import board_json, exports, readers
from pinwall.streaming import evidence_stream

WORDS = {"order", "older", "new", "team", "meeting", "budget", "review", "customer", "process", "design", "plan", "and", "the", "for", "deadline"}
EVIDENCE = "board_id long, note_id long, seq long, engine string, variant string, scope string, line_index int, text string, confidence long"


def R(engine, variant, text, confidence):
    return fusion.Reading(engine, variant, text, confidence)


def known(w):
    return w.lower() in WORDS


def test_consensus_beats_confidence():
    got = fusion.fuse([R("paddle", "rgb", "new 0rder", 95), R("dehtr", "line", "new order", 60), R("tesseract", "block", "new order", 55)], known)
    assert got["text"] == "new order" and got["supporting_engines"] >= 2 and not got["needs_review"]


def test_repeats_of_one_reader_count_once():
    got = fusion.fuse([R("paddle", f"v{i}", "team meeting", 80) for i in range(5)], known)
    assert got["agreement"] == 0 and got["supporting_engines"] == 1 and got["needs_review"] and got["variant"] == "variant-fusion"


def test_missing_lines_are_kept_and_nothing_is_invented():
    rows = [R("paddle", "rgb", "budget\nreview\ndesign", 70), R("dehtr", "line", "budget\ndesign", 75)]
    got = fusion.fuse(rows, known)
    assert got["text"].split("\n") == ["budget", "review", "design"]
    assert fusion.fuse([R("paddle", "rgb", " .. ", 90)], known) is None
    rng = random.Random(4)
    for _ in range(50):
        texts = ["\n".join("".join(rng.choice("abc de") for _ in range(6)) for _ in range(rng.randint(1, 3))) for _ in range(4)]
        rows = [R(rng.choice(["paddle", "dehtr", "tesseract"]), str(i), t, rng.randint(10, 99)) for i, t in enumerate(texts)]
        lines = {x for r in rows for x in r.lines}
        got = fusion.fuse(rows, known)
        assert got is None or set(got["text"].split("\n")) <= lines


def test_fuse_notes_frames(spark):
    rows = [(1, n, i, e, "v", "note", None, t, 70) for n in (1, 2) for i, (e, t) in enumerate([("paddle", "new 0rder"), ("dehtr", "new order"), ("tesseract", "new order")])]
    lexicon = spark.createDataFrame([(w,) for w in WORDS], "word string")
    got = fusion.fuse_notes(spark.createDataFrame(rows, EVIDENCE), lexicon).collect()
    assert [(r.note_id, r.text) for r in sorted(got)] == [(1, "new order"), (2, "new order")]


def test_windows_equal_the_fold_for_measured_readings(spark):
    rng = random.Random(7)
    rows = [(1, n, s, rng.choice(["paddle", "dehtr"]), rng.choice(["rgb", "ink"]), *rng.choice([("note", None), ("line", 0), ("line", 1)]), rng.choice("abcdefgh"), rng.randint(1, 9)) for n in range(30) for s in range(25)]
    df = spark.createDataFrame(rows, EVIDENCE)
    pick = lambda d: sorted(map(tuple, d.select("note_id", "engine", "scope", F.coalesce("line_index", F.lit(-1)), "text", "confidence").collect()))
    assert pick(evidence.retain(df)) == pick(fold.fold_evidence(df))


def test_compatible_characters_are_the_same_reading(spark):
    rows = [(1, 1, 0, "paddle", "rgb", "note", None, "\ufb01le \uff11\uff12", 80), (1, 1, 1, "paddle", "gray", "note", None, "file 12", 70), (1, 1, 2, "dehtr", "line", "note", None, "File 12", 60)]
    df = spark.createDataFrame(rows, EVIDENCE)
    kept = sorted(map(tuple, evidence.retain(df).select("engine", "seq").collect()))
    assert kept == [("dehtr", 2), ("paddle", 0)] == sorted((r.engine, r.seq) for r in fold.fold_evidence(df).collect())
    [vote] = evidence.exact_vote(df).collect()
    assert (vote.norm, vote.engines, vote.sources, vote.confirmed) == ("file 12", 2, 3, True)


def test_protected_terms_are_known(spark):
    rows = [(1, 1, 0, "paddle", "rgb", "note", None, "Kanban API", 80)]
    lexicon = spark.createDataFrame([("order",)], "word string")
    [r] = evidence.assessed(spark.createDataFrame(rows, EVIDENCE), lexicon).collect()
    assert (r.n_words, r.n_known) == (2, 2)
    [f] = fusion.fuse_notes(spark.createDataFrame(rows, EVIDENCE), lexicon).collect()
    assert f.quality == pytest.approx(r.assessment)


def test_the_weak_gate_judges_the_fused_reading(spark):
    """Neither reading is complete; fused they are good enough, which the best single one isn't."""
    rows = [(1, 1, 0, "paddle", "rgb", "note", None, "new order", 60), (1, 1, 1, "dehtr", "line", "note", None, "new order", 58), (1, 2, 0, "paddle", "rgb", "note", None, "xk qz", 60), (1, 2, 1, "dehtr", "line", "note", None, "team plan", 58)]
    df = spark.createDataFrame(rows, EVIDENCE)
    lexicon = spark.createDataFrame([(w,) for w in WORDS], "word string")
    fused = fusion.fuse_notes(df, lexicon)
    got = {r.note_id: (r.weak, r.confidence) for r in evidence.weak_notes(df, fused).collect()}
    assert got[1] == (False, {r.note_id: r.confidence for r in fused.collect()}[1]) and got[2][0]
    alone = {r.note_id: (r.quality, r.confidence) for r in evidence.weak_notes(df, fused.limit(0)).collect()}
    assert alone[1][1] == 60 and alone[1][0] < 64


def test_undo_redo_and_push(spark):
    snapshots = spark.createDataFrame([(b, v) for b in (1, 2) for v in range(1, 5)], "board_id long, version long")
    undone = boards.undo(snapshots).select("board_id", "version", "state")
    state = lambda d: {(r.board_id, r.version): r.state for r in d.collect()}
    assert state(undone)[1, 3] == "current" and state(undone)[1, 4] == "redo"
    assert state(boards.redo(undone))[1, 4] == "current" and state(boards.redo(boards.redo(undone))) == state(boards.redo(undone))
    pushed = state(boards.push(undone, spark.createDataFrame([(1, 9)], "board_id long, version long")))
    assert pushed == {(1, 1): "undo", (1, 2): "undo", (1, 3): "undo", (1, 9): "current", (2, 1): "undo", (2, 2): "undo", (2, 3): "current", (2, 4): "redo"}


def test_symbols_by_hand_make_a_text_sure(spark):
    notes = spark.createDataFrame([(1, 1, "go", 50, ["a"]), (1, 2, "stay", 60, ["b"])], "board_id long, note_id long, text string, confidence long, corrections array<string>")
    got = boards.insert_symbol(notes, spark.createDataFrame([(1, 1, "!")], "board_id long, note_id long, symbol string"))
    assert sorted((r.note_id, r.text, r.confidence, r.corrections) for r in got.collect()) == [(1, "go !", 100, []), (2, "stay", 60, ["b"])]


def test_fold_keeps_representatives():
    state = []
    for i in range(10):
        state = fold.fold(state, {"seq": i, "engine": "paddle", "variant": f"v{i}", "scope": "note", "line_index": None, "text": f"noise {i}", "confidence": 90 + i})
    state = fold.fold(state, {"seq": 10, "engine": "paddle", "variant": "cross-engine-fusion", "scope": "note", "line_index": None, "text": "fused", "confidence": 40})
    assert len(state) == 4 and state[0]["text"] == "fused"
    again = fold.fold(state, state[1] | {"confidence": 99})
    assert len(again) == 4


def test_distances():
    assert S.osa("ca", "abc") == 3 and S.osa("ab", "ba") == 1
    assert S.reading_cost("0rder", "order") == pytest.approx(0.16)
    assert S.reading_cost("rn", "m") == pytest.approx(0.34) and S.reading_cost("clay", "day") == pytest.approx(0.38)
    assert S.digit_variants("b1") == ["bi", "bl"]
    assert S.similarity("Ab-c", "abc") == 1 and S.similarity("", "a") == 0


def test_quads(spark):
    a, b = [(0, 0), (2, 0), (2, 2), (0, 2)], [(1, 1), (3, 1), (3, 3), (1, 3)]
    assert S.quad_shares(a, b) == pytest.approx((1 / 7, 1 / 4)) and S.quad_shares(a, a[::-1]) == pytest.approx((1, 1))
    q = lambda p: [{"x": float(x), "y": float(y)} for x, y in p]
    df = spark.createDataFrame([(q(a), q(b))], "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    assert df.select(S.quad_iou("a", "b")).first()[0] == pytest.approx(1 / 7)


def _board(own=(), suggested=None, preferred=None):
    return correction.Board({"en": frozenset(WORDS), "de": frozenset()}, suggested or {}, set(own), preferred)


def test_correction_is_conservative():
    assert correction.correct_text("mee7ing 2024", _board())[0] == "mee7ing 2024"
    text, changes = correction.correct_text("Meet1ng 0rder", _board())
    assert text == "Meeting Order" or text == "Meeting order" and len(changes) == 2
    assert correction.correct_text("REVEW plan", _board(suggested={"revew": {"en": ["review"]}}))[0] in ("REVEW plan", "REVIEW plan")
    assert correction.correct_text("CUSTOME", _board(suggested={"custome": {"en": ["customer"]}}))[0] == "CUSTOMER"
    assert correction.correct_text("meEting", _board())[0] == "meeting"
    assert correction.correct_text("xyzzy", _board())[0] == "xyzzy"


def test_correct_notes_frames(spark):
    lexicons = spark.createDataFrame([("en", w) for w in WORDS], "lang string, word string")
    notes = spark.createDataFrame([(1, 1, "CUSTOME plan", 80, "paddle"), (1, 2, "new 0rder", 70, "paddle"), (1, 3, "zzz zzz", 50, "paddle")], "board_id long, note_id long, text string, confidence long, engine string")
    seen = spark.createDataFrame([(1, 3, 0, "dehtr", "v", "note", None, "team meeting", 60), (1, 3, 1, "tesseract", "v", "note", None, "team meeting", 55)], EVIDENCE)
    got = {r.note_id: r for r in correction.correct_notes(notes, seen, lexicons).collect()}
    assert got[1].text == "CUSTOMER plan" and got[1].raw_text == "CUSTOME plan" and got[1].confidence == 76
    assert got[2].text == "new order" and got[2].corrections[0]["from"] == "0rder"
    assert got[3].text == "team meeting" and got[3].raw_text == "zzz zzz" and got[3].confidence <= 82


def _notes(spark, rows):
    kind = "board_id long, note_id long, pos long, x double, y double, width double, height double, rotation double, z_index long, color string, text string, confidence long, origin string"
    return spark.createDataFrame([(1, i, i, float(x), float(y), 20.0, 18.0, 5.0, None if i == 1 else i, c, t, 80, "scan") for i, (x, y, c, t) in enumerate(rows)], kind)


def test_grid_and_csv(spark):
    notes = _notes(spark, [(10, 10, "#f7dc68", "a"), (41, 12, "#f2a3b4", "=1+1"), (11, 50, "#abc", 'say "x"'), (40, 49, "red", "d")])
    rows = layout.spreadsheet_rows(notes).orderBy("number").collect()
    assert [(r.note_id, r.row, r.column) for r in rows] == [(0, 1, 1), (1, 1, 2), (2, 2, 1), (3, 2, 2)]
    csv = exports.csv_documents(layout.spreadsheet_rows(notes)).first().csv
    assert csv.startswith("﻿\"Post-it-Nr.\"") and "\"'=1+1\"" in csv and '"say ""x"""' in csv and csv.count("\r\n") == 4
    diagonal = _notes(spark, [(5, 5, "red", "a"), (30, 30, "red", "b"), (55, 55, "red", "c"), (75, 80, "red", "d")])
    assert {(r.row, r.column) for r in layout.spreadsheet_rows(diagonal).collect()} == {(None, None)}


def test_tidy_layout_has_no_overlaps(spark):
    notes = _notes(spark, [((i * 37) % 80, (i * 53) % 80, "red", str(i)) for i in range(24)])
    tidy = boards.tidy_layout(notes, layout.reading_order(notes))
    assert boards.overlapping(tidy).count() == 0 and tidy.where("rotation <> 0 or x < 0 or y < 0 or x + width > 100 or y + height > 100").count() == 0
    assert sorted(r.z_index for r in tidy.collect()) == list(range(2, 26))


def test_json_round_trip_and_rejects(spark):
    notes = _notes(spark, [(10, 10, "#f7dc68", "a"), (41, 12, "#f2a3b4", "b")])
    boards_ = spark.createDataFrame([(1, "tidy", 1.5, "p.png"), (2, "original", 1.6, "q.png")], "board_id long, layout_mode string, aspect_ratio double, file_name string")
    edges = spark.createDataFrame([(1, "e", 0, 1)], "board_id long, edge_id string, source_id long, target_id long")
    docs = board_json.export_boards(boards_, notes, edges, "2024-01-01T00:00:00Z")
    assert "ocrEvidence" not in docs.first().json
    bad = spark.createDataFrame([(8, '{"format":"other","notes":[],"edges":[]}'), (9, "no json")], "board_id long, json string")
    good, rejects = board_json.import_boards(docs.unionByName(bad))
    assert sorted(r.board_id for r in good.collect()) == [1, 2] and sorted(r.board_id for r in rejects.collect()) == [8, 9]
    back = board_json.notes_of(good).orderBy("pos").collect()
    assert [(r.text, r.z_index, r.origin) for r in back] == [("a", 0, "scan"), ("b", 3, "scan")]
    assert board_json.edges_of(good).first().source_id == "0"
    old = spark.createDataFrame([(5, '{"format":"old-board","layoutMode":"x","source":{"aspectRatio":"0"},"notes":[{"id":"n","rotation":"abc"}],"edges":[]}')], "board_id long, json string")
    legacy, _ = board_json.import_boards(old, ("pinwall-board", "old-board"))
    row, note = legacy.first(), board_json.notes_of(legacy).first()
    assert (row.layout_mode, row.aspect_ratio) == ("original", 1.6) and (note.rotation, note.z_index, note.origin) == (0.0, 2, "import")


def test_packages(spark):
    notes = _notes(spark, [(10, 10, "#f7dc68", "a & b"), (41, 12, "#f2a3b4", "c\nd")])
    edges = spark.createDataFrame([(1, 0, 1), (1, 0, 99)], "board_id long, source_id long, target_id long")
    made = pipeline.notes_to_files(spark.createDataFrame([(1, "tidy", 1.6, "x")], "board_id long, layout_mode string, aspect_ratio double, file_name string"), notes, edges.withColumn("edge_id", F.col("target_id").cast("string")), "t")
    for kind, part in (("xlsx", "xl/worksheets/sheet1.xml"), ("pptx", "ppt/slides/slide1.xml")):
        data = bytes(made[kind].first()[kind])
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert data[:2] == b"PK" and b"a &amp; b" in z.read(part)
    kinds = [r.kind for r in exports.slide_shapes(notes, edges).orderBy("layer").collect()]
    assert kinds == ["board", "edge", "note", "note"]


def test_readers_survive_failures(spark):
    def load():
        def one(image):
            if image.mean() < 10:
                raise ValueError("too dark")
            return "budget", 91.6

        return one

    rows = [(1, 1, 0, "rgb", None, 2, 2, bytes([200] * 12)), (1, 2, 0, "rgb", 1, 2, 2, bytes(12))]
    crops = spark.createDataFrame(rows, "board_id long, note_id long, seq long, variant string, line_index int, width int, height int, data binary")
    good, bad = readers.accept(readers.FunctionReader("paddle", load).read(crops))
    assert [(r.note_id, r.text, r.confidence, r.variant) for r in good.collect()] == [(1, "budget", 92, "paddle-rgb")]
    assert bad.first().error == "ValueError: too dark"


def test_items_group_into_rows(spark):
    def box(x, y):
        return [{"x": float(x), "y": float(y)}, {"x": x + 20.0, "y": float(y)}, {"x": x + 20.0, "y": y + 10.0}]

    rows = [(1, 1, "rgb", 0, box(40, 2), "order", 0.9), (1, 1, "rgb", 1, box(5, 0), "new", 0.7), (1, 1, "rgb", 2, box(5, 40), "team", 0.8), (1, 1, "rgb", 3, box(5, 80), " ", 0.9)]
    items = spark.createDataFrame(rows, "board_id long, note_id long, variant string, item int, poly array<struct<x:double,y:double>>, text string, score double")
    assert readers.group_items(items).first().text == "new order\nteam"


def test_pipeline_reads_notes(spark):
    notes = spark.createDataFrame([(1, 1, "new order", 90), (1, 2, "", 0)], "board_id long, note_id long, text string, confidence long")
    first = evidence.simulate(notes.where("text <> ''"))
    lexicons = spark.createDataFrame([("en", w) for w in WORDS], "lang string, word string")
    got = {r.note_id: r for r in pipeline.read_notes(notes.select("board_id", "note_id"), first, [], lexicons).collect()}
    assert got[1].text == "new order" and got[2].engine == "none" and got[2].confidence == 0 and got[2].text == ""


def test_fold_streams_many_notes_a_task(spark):
    rng = random.Random(3)
    scopes = [("note", None), ("note", 3), ("line", None), ("line", 0), ("line", 1), ("other", None)]
    rows = [
        (n // 9, n, i, rng.choice(["paddle", "dehtr", None]), rng.choice(["rgb", "selected", "x-fusion", "aggregate", None]), *rng.choice(scopes), rng.choice(["a", "b", "A b", "d", "\uff41", "..", " ", None]), rng.randint(1, 6))
        for n in range(40)
        for i in range(rng.randint(1, 40))
    ]
    found = fold.fold_evidence(spark.createDataFrame(rng.sample(rows, len(rows)), EVIDENCE))
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapGroups" not in plan
    wanted, names = [], [c.split()[0] for c in EVIDENCE.split(", ")]
    for n in range(40):
        state = []
        for r in rows:
            if r[1] == n and (r[7] or "").strip():
                state = fold.fold(state, dict(zip(names, r)))
        wanted += [tuple(r[c] for c in found.columns) for r in fold.as_rows(state)]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[:3]) == wanted


def test_stream_folds_like_a_batch(spark, tmp_path):
    rows = [(1, n, s, "paddle", f"v{s % 3}", "note", None, f"text {s * 7 % 5}", 40 + s, g) for n in range(3) for g, s in ((0, 0), (0, 1), (1, 2), (1, 3), (1, 4))]
    kind = EVIDENCE + ", generation long"
    df = spark.createDataFrame(rows, kind)
    for i in range(2):
        df.where(F.col("seq") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = {}

    def sink(frame, _):
        for r in frame.collect():
            last.setdefault(r.note_id, {})[(r.generation, r.place)] = (r.text, r.confidence)

    q = evidence_stream.publish(evidence_stream.fold_stream(stream), sink, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(last) == 3 and all(max(g for g, _ in v) == 1 for v in last.values())


def test_edit_verbs(spark):
    notes = _notes(spark, [(10, 10, "red", "a"), (90, 95, "red", "b")])
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "board_id long, source_id long, target_id long")
    kept, left = boards.delete_notes(notes, edges, notes.where("note_id = 1"))
    assert kept.count() == 1 and left.count() == 0
    wanted = spark.createDataFrame([(1, 0, 0), (1, 0, 1)], "board_id long, source_id long, target_id long")
    assert boards.connect(edges, wanted).count() == 2
    files = spark.createDataFrame([("a.png", 10, "image/png"), ("b.txt", 10, "text/plain"), ("c.png", 1 << 30, "image/png")], "path string, length long, media_type string")
    fine, bad = boards.accept_uploads(files)
    assert fine.count() == 1 and bad.count() == 2


def _joins(df):
    """Names of the joins of a plan as it begins, before sizes are known."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sorted(re.findall(r"\w+Join\b", plan.split("Initial Plan")[-1]))


def _readings(spark):
    rows = [(1, n, i, e, "rgb", "note", None, t, 70) for n in (1, 2) for i, (e, t) in enumerate([("paddle", "new 0rder"), ("dehtr", "new order"), ("tesseract", "new order")])]
    return spark.createDataFrame(rows, EVIDENCE)


def test_tokens_meet_final_texts_without_a_broadcast(spark):
    finals = spark.createDataFrame([(1, 1, "new order"), (1, 2, "order")], "board_id long, note_id long, final_text string")
    found = evidence.token_agreement(_readings(spark), finals)
    assert _joins(found) == ["SortMergeJoin"]
    assert {(r.note_id, r.token) for r in found.collect() if not r.agrees} == {(1, "0rder"), (2, "new"), (2, "0rder")}


def test_pairs_of_readings_are_no_broadcast(spark):
    found = evidence.pair_similarity(_readings(spark))
    assert _joins(found) == ["SortMergeJoin"]
    assert sorted((r.note_id, r.left_seq, r.right_seq, round(r.similarity, 3)) for r in found.collect()) == [(n, *p) for n in (1, 2) for p in ((0, 1, 0.875), (0, 2, 0.875), (1, 2, 1.0))]


def _words(spark):
    return spark.createDataFrame([("order",)], "word string")


def test_assessed_readings_are_no_broadcast(spark):
    context = spark.createDataFrame([(1, 1, 1, 8), (1, 2, 1, 8)], "board_id long, note_id long, expected_lines int, expected_chars int")
    found = evidence.assessed(_readings(spark), _words(spark), context)
    # the lexicon may be broadcast, what is known of readings and notes not
    assert _joins(found).count("SortMergeJoin") >= 2 >= len(_joins(found)) - 1
    assert sorted((r.note_id, r.seq, r.n_words, r.n_known) for r in found.collect()) == [(n, *x) for n in (1, 2) for x in ((0, 2, 0), (1, 2, 1), (2, 2, 1))]


def test_collapsed_readers_are_no_broadcast(spark):
    found = evidence.collapse_readers(_readings(spark), _words(spark))
    assert _joins(found).count("SortMergeJoin") >= 4 >= len(_joins(found)) - 1
    assert sorted((r.note_id, r.seq) for r in found.collect()) == [(n, i) for n in (1, 2) for i in range(3)]


def _fused(spark):
    return spark.createDataFrame([(1, 1, "new order", 80), (1, 2, "old", 80)], "board_id long, note_id long, text string, confidence long")


def test_stability_is_no_broadcast(spark):
    found = evidence.stability(_readings(spark), _fused(spark))
    assert _joins(found) == ["SortMergeJoin"]
    assert sorted((r.note_id, round(r.stability, 3)) for r in found.collect()) == [(1, 1.0), (2, 0.25)]
    assert [j for j in _joins(fusion.fuse_notes(_readings(spark), _words(spark))) if j == "SortMergeJoin"]


def test_the_weak_gate_is_no_broadcast(spark):
    found = evidence.weak_notes(_readings(spark), _fused(spark))
    assert _joins(found) == ["SortMergeJoin"] * 4
    assert sorted((r.note_id, r.agreement, r.weak) for r in found.collect()) == [(1, 1.0, False), (2, 1.0, False)]
