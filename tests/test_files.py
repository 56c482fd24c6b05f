"""Folders listed by executors against the operating system's own walk."""

import os
import random

from argentum.sources import files


def test_tree_equals_a_walk(spark, tmp_path):
    rng = random.Random(1)
    root = tmp_path / "card"
    folders = [root]
    for i in range(25):
        folder = rng.choice(folders) / rng.choice([f"d{i}", f".hidden{i}", f"_x{i}", f"sp ace{i}"])
        folder.mkdir(parents=True, exist_ok=True)
        folders.append(folder)
    for i in range(60):
        (rng.choice(folders) / rng.choice([f"_DSC{i}.NEF", f".p{i}.jpg", f"a{i}.txt", f"é{i}.PNG", f"._{i}.jpg"])).write_bytes(b"x" * i)
    (root / ".Trash" / "in").mkdir(parents=True)
    (root / ".Trash" / "in" / "gone.jpg").write_bytes(b"1")
    (root / "d99").mkdir()
    os.symlink(root, root / "d99" / "again", target_is_directory=True)
    os.symlink(root / "nothing", root / "d99" / "broken.jpg")
    want = set()
    for folder, names, found in os.walk(root):
        names[:] = [n for n in names if n not in files.PRUNED]
        for f in found:
            path = os.path.join(folder, f)
            if os.path.isfile(path):
                want.add((path, os.path.getsize(path), int(os.path.getmtime(path))))
    got = files.tree(spark, str(root)).collect()
    assert {(r["path"], r["file_size"], int(r["modified_at"].timestamp())) for r in got} == want and len(got) == len(want)
    photos = {r["filename"] for r in files.walk(spark, f"{root}/").collect()}
    assert photos == {os.path.basename(p) for p, _, _ in want if p.lower().endswith((".nef", ".jpg", ".png")) and not os.path.basename(p).startswith("._")}
    assert files.tree(spark, str(tmp_path / "missing")).collect() == []
    some = root / "d99" / "a b.jpg"
    some.write_bytes(b"xy")
    assert [(r["path"], r["file_size"]) for r in files.tree(spark, (root / "d99").as_uri()).collect()] == [(some.as_uri(), 2)]
