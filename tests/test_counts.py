"""State by cluster: repeats, late rows, restarts and a batch that is run again."""

from pathlib import Path

from graphstrata.streaming.counts import counts_now, stream_counts

SCHEMA = "id string, cluster long, votes long, seq long"


def test_counts_survive_restarts(spark, tmp_path):
    arrivals, out, state = tmp_path / "arrivals", str(tmp_path / "out"), tmp_path / "state"
    arrivals.mkdir()

    def run(name, rows):
        (arrivals / name).write_text("\n".join(rows))
        lines = spark.readStream.schema(SCHEMA).csv(str(arrivals))
        stream_counts(spark, lines, out, str(state)).awaitTermination()
        return {r["cluster"]: tuple(r)[1:] for r in counts_now(spark, out).collect()}

    first = run("1.csv", ["a,1,2,10", "b,1,1,11", "a,1,2,10", "c,2,,12", ",2,1,13", "d,,1,14"])
    assert first == {1: (2, 3, 10, 11), 2: (1, 0, 12, 12)}
    # repeats of rows of the run before, one that is late, and a new cluster
    second = run("2.csv", ["b,1,1,11", "e,1,4,5", "f,9,1,20"])
    assert second == {1: (3, 7, 5, 11), 2: (1, 0, 12, 12), 9: (1, 1, 20, 20)}
    # the last batch was written, but the writer died before it was noted as done
    done = max((f for f in Path(state, "commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    done.unlink()
    Path(done.parent, f".{done.name}.crc").unlink(missing_ok=True)
    third = run("3.csv", ["f,9,1,20", "g,9,3,21"])
    assert third == {**second, 9: (2, 4, 20, 21)}


def test_a_stream_of_nothing(spark, tmp_path):
    (tmp_path / "arrivals").mkdir()
    (tmp_path / "arrivals" / "1.csv").write_text("")
    lines = spark.readStream.schema(SCHEMA).csv(str(tmp_path / "arrivals"))
    stream_counts(spark, lines, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert counts_now(spark, str(tmp_path / "out")).count() == 0
