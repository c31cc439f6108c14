import json

from tideline.streaming import responses


def test_each_file_is_taken_once(spark, tmp_path):
    box, out, seen = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "seen")
    box.mkdir()

    def put(name, *ids):
        (box / name).write_text("\n".join(json.dumps({"patent_number": i, "code": 200, "body": "{}"}) for i in ids))

    def run():
        responses.follow(spark, str(box), "patent_number string, code int, body string", responses.append_once(out), seen).awaitTermination()
        return sorted(r["patent_number"] for r in spark.read.parquet(out).collect())

    put("a.json", "1", "2")
    assert run() == ["1", "2"]
    assert run() == ["1", "2"]
    put("b.json", "3")
    assert run() == ["1", "2", "3"]
