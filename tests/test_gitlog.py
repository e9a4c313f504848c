"""Git logs read from text, against plain Python."""

import random

from corpusloom.sources import gitlog as G


def record(sha, parents="", author="A B", email="a@x", at="2024-03-01T10:00:00+01:00", subject="s", body="", files=()):
    return "\x1e" + "\x1f".join([sha, parents, author, email, at, subject, body, ""]) + "\n" + "\n".join(files) + "\n"


def test_a_log_in_files(spark, tmp_path):
    rng, want, text = random.Random(1), {}, ""
    for i in range(400):
        sha = f"{i:040x}"
        files, rows = [], []
        for j in range(rng.choice([0, 1, 3, 33])):
            kind = rng.choice(["A", "M", "D", "R087", "C100"])
            files.append(f"{kind}\told{j}.go\tdir/new {j}.go" if kind[0] in "RC" else f"{kind}\t./dir/f{j}.go")
            rows.append((sha, kind[0], f"dir/new {j}.go" if kind[0] in "RC" else f"dir/f{j}.go", f"old{j}.go" if kind[0] in "RC" else None))
        body = "\n".join(f"line {k} of é\t|" for k in range(rng.choice([0, 2, 45])))
        parents = " ".join(f"{i - k:040x}" for k in range(rng.choice([0, 1, 2])))
        text += record(sha, parents, subject=f"fix: thing {i} \t x", body=body, files=files)
        want[sha] = (len(parents.split()), len(files), body.count("\n") >= 40, rows if len(rows) <= 32 else [])
    (tmp_path / "one.log").write_text(text)
    (tmp_path / "two.log").write_text(record("f" * 40, subject="torn")[:60] + record("e" * 40, files=["M\t", "garbage", "", "R100\tonly-old", "M\ta.go\r"]) + record("not a hash") + "\x1e" + "d" * 40)
    raw = G.read(spark, str(tmp_path))
    got = {r.sha: r for r in G.commits(raw).collect()}
    assert set(got) == set(want) | {"e" * 40}
    for sha, (parents, files, cut, _) in want.items():
        r = got[sha]
        assert (len(r.parents), r.files, r.truncated, r.merge) == (parents, files, cut, parents > 1)
        assert r.subject.startswith("fix: thing") and r.body.count("\n") <= 39 and r.committed_at is not None
    found = sorted((tuple(r) for r in G.file_changes(raw).collect()), key=str)
    assert found == sorted([x for *_, rows in want.values() for x in rows] + [("e" * 40, "M", "a.go", None)], key=str)


def test_bodies_and_empty_logs(spark, tmp_path):
    (tmp_path / "x.log").write_text(record("a" * 40, body="\n\n  first\n" + "y" * 5000 + "\n", at="bad"))
    (r,) = G.commits(G.read(spark, str(tmp_path))).collect()
    assert r.body.startswith("first\nyy") and len(r.body) == 4096 and r.truncated and r.committed_at is None
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "e.log").write_text("")
    assert G.commits(G.read(spark, str(empty))).count() == 0 and G.file_changes(G.read(spark, str(empty))).count() == 0
