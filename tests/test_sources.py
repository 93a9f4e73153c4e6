import json

from conftest import rows
from popweave import sources
from popweave.session import cut, scratch_path, shared_root


def test_header_json_whole_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([["STATE", "N"], ["01", "3"], ["02", "4"]], indent=1))
    (tmp_path / "b.json").write_text(json.dumps([["N", "STATE"], ["9", "03"]]))
    got = sources.read_header_json(spark, str(tmp_path), {"STATE": "string", "N": "int"})
    assert rows(got) == [("01", 3), ("02", 4), ("03", 9)]


def test_geojson(spark, tmp_path):
    body = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"fd_id": 7}}]}
    (tmp_path / "a.json").write_text(json.dumps(body, indent=1))
    got = sources.read_features(spark, str(tmp_path), "fd_id: bigint")
    assert rows(got, "fd_id", "geometry.x", "geometry.y") == [(7, 1.5, 2.5)]


def test_job_file_names_become_columns(spark, tmp_path):
    (tmp_path / "nc_wac_S000_JT03_2010.csv").write_text("w_geocode,C000\n370510001001001,5\n")
    got = sources.read_job_files(spark, str(tmp_path), "w_geocode string, C000 int")
    assert rows(got) == [("370510001001001", 5, "nc", "wac", "S000", "JT03", "2010")]


def test_materialize_reuses(spark):
    path, calls = scratch_path(spark, "m"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert sources.materialize(spark, build, path).count() == sources.materialize(spark, build, path).count() == 3
    assert calls == [1]


def test_cut_writes_below_the_shared_folder(spark):
    df = cut(spark.range(5))
    assert all(shared_root(spark) in f for f in df.inputFiles()) and df.count() == 5


def test_job_files_are_parsed_once(spark, tmp_path):
    from popweave import sources
    from popweave.plans import jobs
    counts = {"od": ["S000", "SA01"], "wac": ["C000"], "rac": ["C000"]}
    lines = {"nc_od_main_JT00_2010.csv": ["w_geocode,h_geocode,S000,SA01", "01,02,5,3", "09,02,4,4", "09,08,7,7"],
             "nc_od_main_JT01_2010.csv": ["01,02,2,1"], "nc_wac_SA01_JT03_2010.csv": ["w_geocode,C000", "01,6", "09,6"], "nc_rac_SE02_JT05_2010.csv": ["h_geocode,C000", "08,1", "02,2"]}
    for name, text in lines.items():
        (tmp_path / name).write_text("\n".join(text) + "\n")
    area = spark.createDataFrame([("01",), ("05",), ("05",)], "block string")
    files = sources.read_job_families(spark, str(tmp_path), counts)
    assert files.columns == ["state", "od", "segpart", "jobtype", "year", "w_geocode", "h_geocode", "n0", "n1"] and files.count() == 8
    out = jobs.county_job_tables(files, area, counts)
    assert "FileScan text" not in out._jdf.queryExecution().executedPlan().toString()
    got = {tuple(r) for r in out.select("od", "segpart", "w_geocode", "h_geocode", "jobtype", "name", "jobcount", "seg_stem").collect()}
    sums = {}
    for source, w, h, name, n in [("JT00", "01", "02", "S000", 5), ("JT00", "01", "02", "SA01", 3), ("JT01", "01", "02", "S000", 2), ("JT01", "01", "02", "SA01", 1)]:
        for kind in jobs.EXCLUSIVE_TYPES:
            key = ("od", "main", w, h, kind, name, "na")
            sums[key] = sums.get(key, 0) + n * jobs.job_type_equations()[kind].get(source, 0)
    for family, seg, source, w, h, n in [("wac", "SA01", "JT03", "01", None, 6), ("rac", "SE02", "JT05", None, "02", 2)]:
        for kind in jobs.EXCLUSIVE_TYPES:
            sums[(family, seg, w, h, kind, "C000", seg[:2])] = n * jobs.job_type_equations()[kind].get(source, 0)
    assert got == {(*k[:6], n, k[6]) for k, n in sums.items() if n}


def test_counts_of_an_id_are_stored_as_one_list_without_zeros(spark, monkeypatch):
    from popweave.plans import jobs
    stored, store = {}, jobs.cut
    monkeypatch.setattr(jobs, "cut", lambda df, label="cut": stored.setdefault(label, store(df, label)))
    rows_ = [("nc", "od", "main", kind, "2010", "01", "02", n, 0, m) for kind, n, m in (("JT00", 3 * 10**12, 4), ("JT01", 10**12, 9), ("JT02", 3 * 10**12, None))]
    files = spark.createDataFrame([*rows_, ("nc", "wac", "SA01", "JT03", "2010", "01", None, 6, 7, None)],
                                  "state string, od string, segpart string, jobtype string, year string, w_geocode string, h_geocode string, n0 long, n1 long, n2 long")
    counts = {"od": ["S000", "SA01", "SA02"], "wac": ["C000"], "rac": ["C000"]}
    out = jobs.county_job_tables(files, spark.createDataFrame([("01",)], "block string"), counts)
    got = {tuple(r) for r in out.select("od", "jobtype", "name", "jobcount").collect()}
    assert got == {("od", "JT07", "S000", 10**12), ("od", "JT07", "SA02", 9), ("od", "JT09", "S000", 3 * 10**12), ("od", "JT11", "S000", -(10**12)), ("od", "JT11", "SA02", -5),
                   *[("wac", kind, "C000", n) for kind, n in (("JT03", 6), ("JT07", -6), ("JT09", -6), ("JT11", 6))]}
    assert len(stored["tallies"].columns) == 6
    assert stored["tallies"].selectExpr("max(size(_counts))").first()[0] == 8  # the second count of the work file has no name, but is not zero
