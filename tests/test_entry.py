import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "a03_dup_matrix" in e.queries()


def test_imports_without_the_training_data_folder(tmp_path):
    for name in ("helixmill", "__spark_entry__.py"):
        os.symlink(os.path.join(ROOT, name), tmp_path / name) if name.endswith(".py") else None
    os.makedirs(tmp_path / "helixmill")
    for d in os.listdir(os.path.join(ROOT, "helixmill")):
        if d not in ("llm", "__pycache__"):
            os.symlink(os.path.join(ROOT, "helixmill", d), tmp_path / "helixmill" / d)
    code = "import sys; sys.path.insert(0, '.'); import helixmill.plans.catalog as c; from importlib import util; assert util.find_spec('helixmill.llm') is None; exec(open('__spark_entry__.py').read().replace('os.path.abspath(__file__)', repr('./x'))); assert 'a03_dup_matrix' in queries() and not [q for q in queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", ["a03_dup_matrix", "a07_bam_stat", "a16_depth_histogram", "a21_junctions", "a24_tin", "a28_fragment_summary", "a37_snp_fingerprint", "a40_deciles", "a17_gc_report", "a22_junction_saturation_thrice", "a23_inner_distance", "a26_read_origin_reverse", "a27_bias", "a27_coverage_profile", "a39_per_gene_table", "f11_checksums", "m01_duplication_fit", "u05_samples", "w11_duplication_boxes"])
def test_queries_agree_with_their_sql(spark, name):
    import duckdb

    from helixmill.plans import catalog

    con = duckdb.connect()
    for t in ("lineitem", "part", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalog.queries()[name](spark, DATA).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    import pandas as pd

    rows = lambda d: list(tuple(None if pd.isna(x) else round(float(x), 5) if not isinstance(x, str) else x for x in r) for r in d[columns].astype(object).itertuples(index=False))
    a, b = (sorted(map(str, rows(d))) for d in (got, want))
    assert a == b
