"""The entry points: names, guards, and that the corpus operators can be left out."""

import subprocess
import sys
import textwrap

import __spark_entry__


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_corpus_operators():
    code = """
    import sys
    sys.modules["shelfstream.llm"] = None
    import __spark_entry__ as e
    assert "ret10_hybrid_fusion" in e.queries() and "pipeline" not in e.queries() and not any(n.startswith("op") for n in e.oracle_sql())
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=__spark_entry__.__file__.rsplit("/", 1)[0])
