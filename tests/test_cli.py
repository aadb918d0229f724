"""Commands on a small archive."""

import json
import subprocess
import zipfile

from evispark.cli import main


def test_packets_exports_and_projections(spark, tmp_path):
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "people_index.json").write_text(json.dumps([{"person_id": "p1", "display_name": "P One", "birth_date": "1900", "is_potentially_living": False, "other": 1}, {"person_id": "p2", "is_potentially_living": True}]))
    (folder / "archive_manifest.json").write_text(json.dumps([{"relative_path": "a/x.jpg", "filename": "x.jpg", "privacy_label": "public_ok", "sha256": "h"}, {"relative_path": "a/y.jpg", "filename": "y.jpg"}]))
    (folder / "source_links.json").write_text(json.dumps([{"person_id": "p1", "relative_path": "a/x.jpg", "match_confidence": "probable"}]))
    for command in ("packets", "packet-sources", "export", "static-site", "bibliography"):
        assert main([command, str(folder), str(tmp_path / command), "--profile", "public_redacted"], spark) == 0
    lines = spark.read.parquet(str(tmp_path / "packets"))
    assert {r.person_id for r in lines.select("person_id").distinct().collect()} == {"p1"} and lines.where("line like '- `a/x.jpg` (%'").count() == 1
    assert spark.read.parquet(str(tmp_path / "packet-sources")).count() == 1
    assert {r.relative_path: r.include for r in spark.read.parquet(str(tmp_path / "export")).collect()} == {"a/x.jpg": True, "a/y.jpg": False}
    assert [r.title for r in spark.read.parquet(str(tmp_path / "static-site")).collect()] == ["x.jpg"]
    assert main(["packets", str(folder), str(tmp_path / "z"), "--profile", "loud"], spark) == 2


def test_scan_zip_and_boundary(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    (repo / ".hidden.md").write_text("a Forbidden-Name here")
    (repo / "b.md").write_bytes(b"forbidden-name \xff")  # no UTF-8: not read
    (repo / "untracked.md").write_text("forbidden-name")
    subprocess.run(["git", "init", "-q"], cwd=repo, check=True)
    subprocess.run(["git", "add", "b.md", ".hidden.md"], cwd=repo, check=True)
    subprocess.run(["git", "remote", "add", "origin", "https://x.org/forbidden-name"], cwd=repo, check=True)
    assert main(["scan", str(repo), str(tmp_path / "scan")], spark) == 0
    assert {r.relative_path for r in spark.read.parquet(str(tmp_path / "scan")).collect()} == {".hidden.md", "b.md", "untracked.md"}
    assert main(["boundary-audit", str(repo), str(tmp_path / "audit"), "--term", "forbidden-name", "--strict"], spark) == 1
    assert {(r.location, r.kind) for r in spark.read.parquet(str(tmp_path / "audit")).collect()} == {("git remote -v", "remote")} | {(".hidden.md", "file_content")}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m", "x")
    assert main(["inspect-zip", str(tmp_path / "a.zip"), str(tmp_path / "zip")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "zip")).first().member_path == "m"
