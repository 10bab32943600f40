import os
import shutil
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

import corpus_pipeline
from quarry.llm import decontamination, mixing, ngram_join, quality_classifier, quality_rules
from quarry.session import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(autouse=True)
def spark_home(tmp_path_factory, monkeypatch):
    """A home of links to Spark's, in which the workers of a local cluster can make their folder `work`."""
    home = tmp_path_factory.mktemp("home")
    for path in Path(os.environ.get("SPARK_HOME") or Path(pyspark.__file__).parent).iterdir():
        if path.name != "work":
            (home / path.name).symlink_to(path)
    monkeypatch.setenv("SPARK_HOME", str(home))


def test_stages_compose_the_operators(spark):
    docs = table(spark, SF, "documents")
    kept = {r["doc_id"] for r in quality_rules.verdicts(quality_rules.ledger(docs)).filter("kept").collect()}
    now = docs.filter(docs.doc_id.isin(list(kept)))
    model = quality_classifier.trained(docs, table(spark, SF, "labels"))
    good = {r["doc_id"] for r in quality_classifier.scored(now, model).filter("quality_score >= 0.3").collect()}
    now = now.filter(now.doc_id.isin(list(good)))
    first = {r["doc_id"] for r in ngram_join.linked_components(now).filter("doc_id = component_id").collect()}
    now = now.filter(now.doc_id.isin(list(first)))
    clean = {r["doc_id"] for r in decontamination.scanned(now, table(spark, SF, "benchmark")).filter("not contaminated").collect()}
    now = now.filter(now.doc_id.isin(list(clean)))
    expected = sorted((r["doc_id"], r["mix_copy"]) for r in mixing.mixed_to_targets(now).collect())
    assert sorted((r["doc_id"], r["mix_copy"]) for r in corpus_pipeline.run(spark, SF).collect()) == expected


def test_stages_keep_columns_and_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if name != "mixing":
            assert out.columns == docs.columns


APART = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
conf = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": "file://" + sys.argv[2], "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config(map=conf).getOrCreate()
import corpus_pipeline
name, stage = corpus_pipeline.STAGES[int(sys.argv[4])]
print(name, stage(spark, spark.read.parquet(sys.argv[3] + "/documents.parquet"), sys.argv[3]).count())
spark.stop()
"""


@pytest.mark.parametrize("number", [1, 2])
def test_stages_run_on_executors_without_the_package(tmp_path, number):
    """Modules on the driver's sys.path alone, found by no path of the executors."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", APART, str(Path(corpus_pipeline.__file__).parent), str(tmp_path), SF, str(number)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and done.stdout.startswith(corpus_pipeline.STAGES[number][0]), done.stderr[-2000:]


def test_stages_run_from_files_dated_before_1980(tmp_path):
    """As they are unpacked from archives without dates; zip files can't state such a date."""
    top, copy = Path(corpus_pipeline.__file__).parent, tmp_path / "copy"
    shutil.copytree(top / "quarry", copy / "quarry", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(top / "corpus_pipeline.py", copy)
    for path in copy.rglob("*.py"):
        os.utime(path, (0, 0))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", APART, str(copy), str(tmp_path), SF, "1"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and done.stdout.startswith(corpus_pipeline.STAGES[1][0]), done.stderr[-2000:]


def test_package_is_sent_from_a_folder_named_by_process(tmp_path):
    """A temporary folder below /proc/self/cwd is another one to the JVM once Python has changed its folder."""
    for folder in (tmp_path, tmp_path / "own"):
        (folder / ".tmp").mkdir(parents=True)
    moved = APART.replace("import corpus_pipeline", "import os; os.chdir('own')\nimport corpus_pipeline")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"TMPDIR": "/proc/self/cwd/.tmp"}
    done = subprocess.run([sys.executable, "-c", moved, str(Path(corpus_pipeline.__file__).parent), str(tmp_path), SF, "1"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and done.stdout.startswith(corpus_pipeline.STAGES[1][0]), done.stderr[-2000:]
