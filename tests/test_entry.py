"""The entry module without the optional parts."""

import subprocess
import sys

import pytest

from .conftest import HERE

SHOW = "import sys; sys.modules[{name!r}] = None; sys.path.insert(0, {here!r}); import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') and k[2:3].isdigit() for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("name", ["tidewater.llm", "sentencepiece"])
def test_queries_without_a_part(name):
    """Where the corpus operators, or a library that they need, are missing, the others are left."""
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", SHOW.format(name=name, here=HERE)], capture_output=True, text=True, timeout=120)
    n, corpus, pipeline, sql = done.stdout.split()
    assert int(n) > 100 and corpus == "0" and pipeline == "False" and sql == "True"


def test_a_shared_folder_is_needed_on_a_cluster():
    from tidewater.sources import shared

    class Conf:
        get = staticmethod(lambda key: None)

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: Conf)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.folder(Session)
    Context.master = "local[2]"
    assert shared.folder(Session).startswith("file://")
