import json
import struct

from sonorium.operators import mos
from sonorium.sources import audio, sinks, tables
from sonorium.streaming import responses

HEAD = "file_name,id,word,pre_word,fol_word,label,rel_time,F1_s,F2_s,F3_s\n"


def test_tracks(spark, tmp_path):
    for name, body in {"c/s1/a_tracks.csv": HEAD + "x,10,w,,y,AE1,0.1,500,NaN,2500\nx,10,\"w,v\",p,y,AE1,bad,501,1500,2500\n", "c/s1/b_tracks.csv": "only,two\n1,2\n", "d/corpus_m3_1_2_tracks.csv": HEAD + "x,1,w,p,y,iy,0.1,1,2,3\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    rows = tables.tracks(spark, str(tmp_path), ["c", "d", "none"]).orderBy("condition", "row_idx").collect()
    assert [(r.condition, r.speaker, r.word, r.pre_word, r.rel_time, r.F2_s) for r in rows] == [("c", "S1", "w", None, 0.1, None), ("c", "S1", "w,v", "p", None, 1500.0), ("d", "M3", "w", "p", 0.1, 2.0)]
    assert tables.tracks(spark, str(tmp_path), ["none"]).count() == 0


def response(rater, **scores):
    return {"completionCode": rater, "ParticipantInfo": {"finalCheck": "quality", "block": "1"}, **scores}


def test_responses(spark, tmp_path):
    (tmp_path / "r1.json").write_text(json.dumps(response("a", s1={"SIG": 3, "BAK": 4, "OVRL": 5}, s2={"SIG": None, "BAK": 4})))
    (tmp_path / "r2.json").write_text(json.dumps({"taskId": "t", "responses": response("b", s1={"SIG": 1, "BAK": 1, "OVRL": 1})}))
    (tmp_path / "r3.json").write_text("no json")
    got = sorted((r.rater, r.id, r.SIG, r.OVRL, r.finalCheck) for r in tables.responses_json(spark, str(tmp_path / "*.json")).collect())
    assert got == [("a", "s1", 3.0, 5.0, "quality"), ("a", "s2", None, None, "quality"), ("b", "s1", 1.0, 1.0, "quality")]
    sheet = tmp_path / "s.csv"
    sheet.write_text("when,responsesJSON\n1,\"" + json.dumps(response("c", s9={"SIG": 2, "BAK": 2, "OVRL": 2})).replace('"', '""') + "\"\n2,broken\n")
    assert [(r.rater, r.id, r.BAK) for r in tables.responses_csv(spark, str(sheet)).collect()] == [("c", "s9", 2.0)]
    long = tmp_path / "l.csv"
    long.write_text("rater,id,SIG,BAK,OVRL\na,x,1,2,bad\n")
    assert tables.responses_csv(spark, str(long)).first().OVRL is None


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(response(f"r{k % 2}", s1={"SIG": 3, "BAK": 3, "OVRL": 2 + k % 2})))
    mapping = spark.createDataFrame([("s1", "orig", "raw")], "id string, condition string, base string")
    q = responses.running_means(responses.ratings_stream(spark, str(tmp_path / "in")), mapping).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = spark.table("running").first()
    assert (r.n, r.OVRL, r.condition) == (2, 2.5, "orig")


def test_annotations(spark, tmp_path):
    tiers = spark.createDataFrame([("/d/a.TextGrid", "words", 0.0, 1.0, 'say "x"'), ("/d/a.TextGrid", "phones", 0.0, 0.5, "k"), ("/d/a.TextGrid", "phones", 0.5, 1.0, "")], "file string, tier string, xmin double, xmax double, label string")
    text = sinks.annotation_text(tiers).first().value
    (tmp_path / "a.TextGrid").write_text(text)
    (tmp_path / "b.TextGrid").write_bytes(text.encode("utf-16"))
    rows = tables.annotations(spark, str(tmp_path)).collect()
    assert len(rows) == 6
    assert sorted((r.tier, r.pos, r.xmin, r.xmax, r.label) for r in rows if r.file.endswith("a.TextGrid")) == [("phones", 0, 0.0, 0.5, "k"), ("phones", 1, 0.5, 1.0, ""), ("words", 0, 0.0, 1.0, 'say "x"')]


def test_transcripts_and_lists(spark, tmp_path):
    (tmp_path / "a.trans").write_text("m1\n0,0.5,k, MOVE,x, y\n0.5,bad,k,w,s\n0.5,1,,,s\n1,2\n")
    got = [(r.speaker, r.xmin, r.xmax, r.phone, r.word) for r in tables.transcripts(spark, str(tmp_path / "a.trans")).orderBy("pos").collect()]
    assert got == [("m1", 0.0, 0.5, "k", "MOVE"), ("m1", 0.5, 1.0, "sp", "sp")]
    (tmp_path / "list.txt").write_text("001 : It's A test.\nnot one\n12: two 2\n")
    assert sorted((r.sid, r.tokens) for r in tables.sentence_list(spark, str(tmp_path / "list.txt")).collect()) == [(1, ["it's", "a", "test"]), (12, ["two"])]
    assert sorted(r.tokens for r in tables.sentence_list(spark, str(tmp_path / "list.txt"), True).collect()) == [["it's", "a", "test"], ["two", "2"]]
    assert tables.sentence_list(spark, str(tmp_path / "none.txt")).count() == 0
    (tmp_path / "t.txt").write_text("One two. Three!\nFour; ")
    assert [r.sentence for r in tables.transcript_sentences(spark, str(tmp_path / "t.txt")).orderBy("pos").collect()] == ["One two", "Three", "Four"]


def wav(rate, values):
    data = struct.pack(f"<{2 * len(values)}h", *(x for v in values for x in (v, 0)))
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, rate, rate * 4, 4, 16) + b"data" + struct.pack("<I", len(data)) + data


def test_audio(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(16000, [0, 16384, -16384]))
    (tmp_path / "b.wav").write_bytes(b"junk")
    rows = {r.path[-5:]: r for r in audio.files(spark, str(tmp_path)).collect()}
    assert (rows["a.wav"].rate, rows["a.wav"].channels, rows["a.wav"].frames, rows["b.wav"].rate) == (16000, 2, 3, None)
    assert [r["sample"] for r in audio.sample_rows(spark, str(tmp_path)).orderBy("idx").collect()] == [0.0, 0.5, -0.5]
    assert [(r.rate, r.files, r.mixed) for r in audio.rate_histogram(audio.files(spark, str(tmp_path))).collect()] == [(16000, 1, False)]
    assert tables.listing(spark, str(tmp_path), "*.wav").count() == 2 and tables.listing(spark, str(tmp_path / "none")).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.01, 0.02), ("b", 0.5, 0.9)], "name string, p double, p_holm double")
    assert [r.line for r in sinks.test_lines(df).collect()] == ["a: p=0.0100, p_holm=0.0200*", "b: p=0.500, p_holm=0.900"]
    sinks.csv(df, str(tmp_path / "o"), True)
    assert spark.read.option("header", "true").csv(str(tmp_path / "o")).count() == 2
    sinks.diagnostics(spark.range(1), df, str(tmp_path / "d"))
    assert len(spark.read.json(str(tmp_path / "d")).first()["sample"]) == 2
    assert sinks.boxes(spark.createDataFrame([("a", float(k)) for k in range(5)], "g string, v double"), ["g"], "v").first().median == 2.0
    assert mos.roles(spark.createDataFrame([("x",), ("x",)], "role string")).first().n == 2


def test_annotation_values(spark):
    text = 'File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = 3\ntiers? <exists>\nsize = 2\nitem []:\n item [1]:\n class = "TextTier"\n name = "marks"\n xmin = 0\n xmax = 3\n points: size = 1\n points [1]:\n number = 1\n mark = "m 5"\n'
    text += ' item [2]:\n class = "IntervalTier"\n name = "words"\n xmin = 0\n xmax = 3\n intervals: size = 2\n intervals [1]:\n xmin = 0\n xmax = 1.5\n text = "a ""b""\nc = 7"\n intervals [2]:\n xmin = 1.5\n xmax = 3\n text = ""\n'
    want = [("words", 0, 0.0, 1.5, 'a "b"\nc = 7'), ("words", 1, 1.5, 3.0, "")]
    assert tables.parse_annotation(text) == want
    assert tables.parse_annotation('"IntervalTier" "words" 0 3 2\n0 1.5 "a ""b""\nc = 7"\n1.5 3 ""') == want and tables.parse_annotation("") == []


def test_samples_of_a_file_with_other_chunks():
    data = struct.pack("<4h", 1000, 2000, 3000, 4000)
    body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"LIST" + struct.pack("<I", 8) + b"data\x04\0\0\0" + b"data" + struct.pack("<I", len(data)) + data
    wav = b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body
    assert [round(x * 32768) for x in audio.samples(wav)] == [1000, 2000, 3000, 4000] and audio.samples(b"fLaC") is None
    wide = body.replace(struct.pack("<IIHH", 8000, 16000, 2, 16), struct.pack("<IIHH", 8000, 24000, 3, 24)).replace(data, b"\0\0\x40\0\0\xc0")
    assert audio.samples(b"RIFF" + struct.pack("<I", 4 + len(wide)) + b"WAVE" + wide) == [0.5, -0.5]


def test_named_files(spark, tmp_path):
    """A file for each name, whole; others stay; a task that fails leaves nothing."""
    (tmp_path / "old.txt").write_text("old")
    df = spark.createDataFrame([(f"{k}.TextGrid", f"text {k}\nü") for k in range(9)] + [("old.txt", None)], "name string, value string").repartition(3)
    sinks.named_files(df, str(tmp_path))
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {f"{k}.TextGrid": f"text {k}\nü" for k in range(9)} | {"old.txt": ""}
    import pytest

    with pytest.raises(Exception, match="no name for a file"):
        sinks.named_files(spark.createDataFrame([("a", "x"), ("b/c", "y")], "name string, value string").repartition(2), str(tmp_path / "two"))
    assert not list((tmp_path / "two").glob("*"))


def test_annotation_files_come_back(spark, tmp_path):
    tiers = spark.createDataFrame([(f"/d/{n}.TextGrid", "words", 0.0, 1.0, f'say "{n}"') for n in "ab"], "file string, tier string, xmin double, xmax double, label string")
    sinks.annotation_files(tiers, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.TextGrid", "b.TextGrid"]
    assert sorted(r.label for r in tables.annotations(spark, str(tmp_path / "out")).collect()) == ['say "a"', 'say "b"']


def test_stimulus_files(spark, tmp_path):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([("stim_0002", "gold", 's "x", y', "2.wav"), ("stim_0001", "experimental", None, "1.wav")], "id string, role string, utterance string, filename string")
    url = F.concat(F.lit("https://host/"), "filename")
    none = spark.createDataFrame([], "file string, reason string")
    sinks.stimulus_files(items, none, url, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["audioSamples.js.txt", "audioSamples.json", "mapping.csv"]
    assert json.loads((tmp_path / "audioSamples.json").read_text()) == [{"id": "stim_0001", "url": "https://host/1.wav", "utt": None}, {"id": "stim_0002", "url": "https://host/2.wav", "utt": 's "x", y'}]
    rows = tables.mapping(spark, str(tmp_path / "mapping.csv")).collect()
    assert [(r.id, r.role, r.utterance) for r in rows] == [("stim_0001", "experimental", None), ("stim_0002", "gold", 's "x", y')]
    assert (tmp_path / "audioSamples.js.txt").read_text().startswith("const audioSamples = [\n    { id: \"stim_0001\", url: ")
    sinks.stimulus_files(items, spark.createDataFrame([("f", "no_match")], "file string, reason string"), url, str(tmp_path))
    assert json.loads((tmp_path / "mismatches.json").read_text()) == [{"file": "f", "reason": "no_match"}]


def test_tracks_by_layout(spark, tmp_path):
    """Files of several headers, quoted line feeds, names with signs of patterns; only what is required is parsed."""
    (tmp_path / "c" / "s [1]").mkdir(parents=True)
    other = "label,F3_s,F2_s,F1_s,rel_time,fol_word,extra,pre_word,word,id,file_name\n"
    (tmp_path / "c" / "s [1]" / "a_tracks.csv").write_text(HEAD + 'x,1,"two\nlines",p,"a ""q""",iy,0.1,1,2,3\nx,2, w ,p,y,iy,0.2,4,5,6\n')
    (tmp_path / "c" / "s [1]" / "b_tracks.csv").write_text(other + "iy,3,2,1,0.5,y,zz,p,w,9,x\n")
    (tmp_path / "c" / "s [1]" / "c_tracks.csv").write_text("")
    df = tables.tracks(spark, str(tmp_path), ["c"], upper=False)
    got = {(r.id, r.word, r.fol_word, r.F1_s, r.F3_s, r.speaker) for r in df.collect()}
    assert got == {("1", "two\nlines", 'a "q"', 1.0, 3.0, "s [1]"), ("2", "w", "y", 4.0, 6.0, "s [1]"), ("9", "w", "y", 1.0, 3.0, "s [1]")}
    plan = df.select("id", "F1_s")._jdf.queryExecution().executedPlan().toString()
    assert "F2_s" not in plan.split("ReadSchema")[-1] and "ReadSchema: struct<id:string,F1_s:string>" in plan
    (tmp_path / "d").mkdir()
    for n in ("usctimit_mri_f1_3_tracks.csv", "usc_s1_1_tracks.csv"):
        (tmp_path / "d" / n).write_text(HEAD + "x,1,w,p,y,iy,0.1,1,2,3\n")
    speakers = lambda flat: sorted(r.speaker for r in tables.tracks(spark, str(tmp_path), ["d"], flat=flat).collect())
    assert speakers("frames") == ["?", "F1"] and speakers("errors") == ["F1", "S1"]


def test_needed_parts(spark, tmp_path):
    import pytest

    tiers = spark.createDataFrame([("/d/a.TextGrid", "phones", 0.0, 1.0, "k")], "file string, tier string, xmin double, xmax double, label string")
    sinks.annotation_files(tiers, str(tmp_path / "t"))
    assert tables.annotations(spark, str(tmp_path / "t"), "words").count() == 0
    with pytest.raises(Exception, match="has no tier 'words'"):
        tables.annotations(spark, str(tmp_path / "t"), "words", needed=True).collect()
    (tmp_path / "a.trans").write_text("m1\n0,0.5,k,w,s\n")
    assert tables.transcripts(spark, str(tmp_path / "*.trans"), needed=True).count() == 1
    (tmp_path / "b.trans").write_text("m1\nno times\n")
    assert tables.transcripts(spark, str(tmp_path / "*.trans")).count() == 1
    with pytest.raises(Exception, match="has no line with times"):
        tables.transcripts(spark, str(tmp_path / "*.trans"), needed=True).collect()
    (tmp_path / "l.txt").write_text("nothing\n")
    with pytest.raises(ValueError, match="has no sentences"):
        tables.sentence_list(spark, str(tmp_path / "l.txt"), True)


def test_report_text(spark, tmp_path):
    from pyspark.sql import functions as F

    from sonorium.operators import stats

    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 9.0), ("b", 8.0), ("c", None), ("ref", 1.5), ("ref", 2.5)], "condition string, v double")
    tests = stats.mann_whitney_against(df.where("condition <> 'ref'"), ["condition"], "v", df.where("condition = 'ref'")).withColumn("p_holm", F.col("p"))
    sinks.report([("summary", sinks.summary_lines(stats.summary(df, ["condition"], "v"))), ("tests", sinks.u_lines(tests, "REF"))], str(tmp_path))
    lines = (tmp_path / "stats.txt").read_text().split("\n")
    assert lines[0] == "-- summary --" and lines[1] == "               a: n=    3  mean=2.3333  median=2.0000  sd=1.5275" and lines[3] == "               c: (no data)"
    assert lines[5] == "-- tests --" and lines[6].startswith("  REF vs a           : p=") and lines[6].endswith("(n_ref=2, n=3)") and "Δmed=+0.0000" in lines[6]
    paired = spark.createDataFrame([("a-b", 0.01, 0.02, 0.5, 9), ("a-c", None, None, None, 2)], "pair string, p double, p_holm double, rank_biserial double, n_pairs int")
    assert [r.line for r in sinks.signed_rank_lines(paired).collect()] == ["  a-b                 : p=0.0100  p_holm=0.0200*  r=+0.50  (n_pair=9)", "  a-c                 : no test (n_pair=2)"]
