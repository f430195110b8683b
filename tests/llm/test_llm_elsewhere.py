"""Every registered query of the subpackage and the pipeline, from another folder, without the package on the workers' path."""

from swellframe.llm import queries
from tests.test_elsewhere import ran


def test_queries_from_another_folder(tmp_path):
    names = [*queries.queries(), "pipeline"]
    rows, said = ran(names, tmp_path)
    assert list(rows) == names and all(int(n) > 0 for n in rows.values()), said
