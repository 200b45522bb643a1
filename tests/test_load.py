"""The query registry loads without touching files of the installation."""

import subprocess
import sys
import textwrap
from pathlib import Path

from trilith.functions.constants import FRENCH_STOPWORDS

ROOT = Path(__file__).resolve().parent.parent


def test_loads_without_jars_or_archives():
    code = """
        import glob, zipfile
        def no(*a, **k):
            raise OSError("no file access at import")
        glob.glob = glob.iglob = no
        zipfile.ZipFile.__init__ = no
        import __spark_entry__ as e
        from trilith.plans import registry
        q, o = e.queries(), e.oracle_sql()
        assert not registry.LOAD_ERRORS, registry.LOAD_ERRORS
        own = set(registry.QUERIES)
        assert len(own) >= 119 and own <= set(q) and len(o) >= 91, (len(own), len(o))
    """
    r = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=ROOT, capture_output=True, text=True)
    assert r.returncode == 0, r.stderr[-2000:]


def test_french_stop_list_is_the_one_of_spark(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert list(FRENCH_STOPWORDS) == list(StopWordsRemover.loadDefaultStopWords("french"))


def test_everything_else_works_without_the_optional_parts():
    code = """
        import sys
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name == "corpus_pipeline" or name.startswith("trilith.llm"):
                    raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        q, o = e.queries(), e.oracle_sql()
        assert len(q) >= 119 and not any(k.startswith("op") and k[2].isdigit() or k == "pipeline" for k in q), sorted(q)
        assert set(o) <= set(q)
    """
    r = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=ROOT, capture_output=True, text=True)
    assert r.returncode == 0, r.stderr[-2000:]
