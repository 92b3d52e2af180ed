"""Lines of longer records find their opener where they are read."""
import os
import tempfile

from tabprep.sources import files as FS


def test_no_task_sorts_the_lines_of_a_split(spark):
    d = tempfile.mkdtemp(prefix="tabprep-openers-")
    with open(os.path.join(d, "q.csv"), "w") as f:
        f.write("".join(f'{i},"a\nb ""{i}"",\n\nc"\n{i},x\n' for i in range(500)))
    df = FS.safe_read(spark, d, "utf-8", ",", ["n", "note"])
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == sorted((str(i), v) for i in range(500) for v in (f'a\nb "{i}",\n\nc', "x"))
