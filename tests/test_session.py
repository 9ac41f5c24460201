import glob
import os
import subprocess
import sys

from pyspark.sql import functions as F

from siltstone import session


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("spread"))


def test_spread_starts_no_job(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).select(F.col("id") % 7).distinct()
    spark.sparkContext.setJobGroup("spread", "spread")
    try:
        wide = session.spread(df)
        assert jobs(spark) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert wide.count() == 7 and wide.rdd.getNumPartitions() == session.width(spark)


def test_scratch_tables_are_removed(spark):
    df = session.materialize(spark.range(10), "kept")
    assert df.count() == 10
    root = session.scratch_root(spark).removeprefix("file://")
    own = f"{root}/siltstone/{spark.sparkContext.applicationId}"
    assert glob.glob(f"{own}/kept-*")
    session.clear_scratch(spark)
    assert not os.path.exists(own) and session.materialize(spark.range(3)).count() == 3


def test_workers_need_no_installation(tmp_path):
    """A function of the package on a table that the package did not read, with workers that do not find it by themselves."""
    script = tmp_path / "job.py"
    root = os.path.dirname(os.path.dirname(os.path.abspath(session.__file__)))
    script.write_text(
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession, functions as F\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from siltstone.functions import markup\n"
        "df = spark.createDataFrame([('<p>one</p><p>two</p>',)], 'page string')\n"
        "print('said', df.select(markup.article_text(F.col('page'))).first()[0].split())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "said ['one', 'two']" in done.stdout, done.stderr[-2000:]
