"""What is written in a text format is read back."""

from pyspark.sql import functions as F

from tessera.sources import text_files as files


def test_raw(spark, tmp_path):
    rows = spark.createDataFrame([(s, t, s + t / 4) for s in range(3) for t in range(5)], "series_id int, t int, x double")
    files.write_raw(rows, f"{tmp_path}/raw")
    got = files.read_raw(spark, f"{tmp_path}/raw/*/*.txt").select(F.regexp_extract("file", "series_id=(\\d+)", 1).cast("int").alias("s"), "t", F.get("x", F.lit(0)).alias("x"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_neighbours(spark, tmp_path):
    knn = spark.createDataFrame([(0, 1, 2, 0.5), (0, 2, 1, 0.75), (1, 1, 0, 0.25), (1, 2, 2, 1.5)], "win_id long, rank int, nbr_id long, dist double")
    lines = [r.line for r in files.neighbour_lines(knn).orderBy("win_id").collect()]
    (tmp_path / "knn.txt").write_text("2 2 8 8 4\n" + "\n".join(lines) + "\n")
    assert sorted(map(tuple, files.read_neighbours(spark, f"{tmp_path}/knn.txt").collect())) == sorted(map(tuple, knn.collect()))


def test_motifs(spark, tmp_path):
    m = spark.createDataFrame([(0, "ab", 2, -1.5, 0, 3, 6), (0, "ab", 2, -1.5, 1, 4, 6), (1, "ba", 1, -0.5, 0, 9, 7)], "motif_id long, hash string, n_fixed int, mdl double, series_id int, start int, len int")
    files.write_motifs(m, f"{tmp_path}/m")
    assert sorted(map(tuple, files.read_motifs(spark, f"{tmp_path}/m/*.txt").collect())) == sorted(map(tuple, m.collect()))


def test_patterns_labels_indices(spark, tmp_path):
    (tmp_path / "p.txt").write_text("* note\npattern\n0 3 5\n1 4 5\nPattern\n2 0 7\n")
    assert sorted(map(tuple, files.read_patterns(spark, f"{tmp_path}/p.txt").collect())) == [(0, 0, 3, 5), (0, 1, 4, 5), (1, 2, 0, 7)]
    labels = spark.createDataFrame([(0, "a b", 1, 4), (0, "c", 4, 9)], "series_id int, tag string, start int, stop int")
    files.write_labels(labels, f"{tmp_path}/l")
    assert sorted((r.tag, r.start, r.stop) for r in files.read_labels(spark, f"{tmp_path}/l/*/*.txt").collect()) == [("a b", 1, 4), ("c", 4, 9)]
    (tmp_path / "i.txt").write_text("4\n\n17\n")
    assert sorted(r.win_id for r in files.read_indices(spark, f"{tmp_path}/i.txt").collect()) == [4, 17]


def test_any_format(spark, data):
    got = files.read_with(spark, "parquet", f"{data}/events.parquet", lambda df: df.where("value > 10"), lambda df: df.select("value"))
    assert got.columns == ["value"] and got.where("value <= 10").count() == 0


def test_neighbour_files(spark, tmp_path):
    knn = spark.createDataFrame([(0, 1, 2, 0.5), (0, 2, 1, 0.75), (1, 1, 0, 0.25), (1, 2, 2, 1.5)], "win_id long, rank int, nbr_id long, dist double")
    for sizes, want in (((8, 12, 4), {"n": 2, "k": 2, "low": 8, "high": 12, "step": 4}), ((8, 4), {"n": 2, "k": 2, "size": 8, "step": 4})):
        path = f"{tmp_path}/knn{len(sizes)}"
        files.write_neighbours(knn, path, *sizes)
        assert files.neighbour_header(spark, f"{path}/*.txt") == want
        assert sorted(map(tuple, files.read_neighbours(spark, f"{path}/*.txt").collect())) == sorted(map(tuple, knn.collect()))


def test_definitions(spark, tmp_path):
    entries = [{"name": "a", "data": "a.txt", "dataLoader": "DLRaw"}, {"name": "b", "data": "b.txt"}]
    (tmp_path / "d.def").write_text("# all of it\n" + files.definition(entries))
    assert files.read_definition(spark, f"{tmp_path}/d.def") == entries
    (tmp_path / "l.def").write_text(files.looped_definition({"name": "s_$(i)", "data": "raw/$(i)"}, 3) + "!(for,k,2,2,6)\n<data>\nname = t_$(k)\n</data>\n!(endfor)\n")
    assert [e["name"] for e in files.read_definition(spark, f"{tmp_path}/l.def")] == ["s_1", "s_2", "s_3", "t_2", "t_4", "t_6"]


def test_dataset_round_trip(spark, tmp_path):
    """A synthetic labelled data set is exported and read back through its definition."""
    rows = spark.createDataFrame([(s, t, float(s + t)) for s in (1, 2) for t in range(6)], "series_id int, t int, x double")
    labels = spark.createDataFrame([(s, "c", 1, 4) for s in (1, 2)], "series_id int, tag string, start int, stop int")
    files.write_dataset(rows, labels, f"{tmp_path}/out")
    entries = files.read_definition(spark, f"{tmp_path}/out/def/*.txt")
    assert [e["name"] for e in entries] == ["set_1", "set_2"]
    for s, e in zip((1, 2), entries):
        got = files.read_raw(spark, f"{tmp_path}/out/{e['data']}/*.txt")
        assert sorted((r.t, r.x[0]) for r in got.collect()) == [(t, float(s + t)) for t in range(6)]
        assert [(r.tag, r.start, r.stop) for r in files.read_labels(spark, f"{tmp_path}/out/{e['labels']}/*.txt").collect()] == [("c", 1, 4)]


def test_cuts(spark, tmp_path):
    files.write_cuts(spark.createDataFrame([(3, 0, 9), (3, 12, 20)], "series_id int, a int, b int"), f"{tmp_path}/cuts")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/cuts").collect()) == ['"3" 0 9', '"3" 12 20']
