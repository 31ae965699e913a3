import random
import zlib

from vellumspark.operators import checksums
from vellumspark.plans import digests, packages
from vellumspark.plans.compile import Corpus
from vellumspark.sources import package as P


def test_sections_are_those_of_the_packages(spark):
    docs = [
        (1, "html", "<title>é</title><h1>A</h1><ol start=7><li><a href=x>one</a><li>two</ol><table><tr><td colspan=2>c<td rowspan=3>d</table>"),
        (2, "markdown", "# T ü\n\npara *em* **x** `c`\n\n- a\n- b\n\n> q\n\n1. one"),
        (3, "markdown", ""),
        (4, "html", "<style>p { color: #12345678; font-size: 1.3em; letter-spacing: -0.25px } .k { line-height: 2 }</style><p>a<p class=k>b <u>c</u><pre> code\n</pre>"),
        (5, "html", "<p>" + "a" * 300 + f"<a href={'u' * 200}>v</a>"),
        (6, "html", "<p>pic <img src=a.png alt='ä b'><p>pic"),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, kind string, source string")
    c = Corpus(docs)
    got = {r["doc_id"]: r for r in digests.sections(c).collect()}
    ids = {r["doc_id"]: r["document_id"] for r in digests.document_ids(c).collect()}
    for r in packages.pack(c, docs).collect():
        _, payloads = P.parse(bytes(r["bytes"]))
        mine = got[r["doc_id"]]
        assert [bytes(mine[x]) for x in ("chnk", "styl", "cont")] == [payloads[P.SECTIONS[x]] for x in ("CHNK", "STYL", "CONT")]
        assert ids[r["doc_id"]] == P.decode_info(payloads[P.SECTIONS["INFO"]])["document_id"]
    assert len(got) == 6


def test_checksums_of_pieces(spark):
    rng = random.Random(4)
    whole = {i: rng.randbytes(n) for i, n in enumerate([0, 1, 2, 255, 256, 1000, 70_000, 3])} | {50: b"\0" * 9, 51: b"\xff" * 40_000}
    rows = []
    for i, data in whole.items():
        at = 0
        while at < len(data) or at == 0:
            n = rng.choice([1, 7, 300, 9000]) if data else 0
            rows.append((i, at, data[at : at + n] if data else None))
            at += max(n, 1)
    rng.shuffle(rows)
    got = checksums.checksums(spark.createDataFrame(rows, "id int, offset long, piece binary"), ["id"], "offset", "piece").collect()
    assert {r["id"]: (r["size"], r["adler32"], r["crc32"]) for r in got} == {i: (len(d), zlib.adler32(d), zlib.crc32(d)) for i, d in whole.items()}
    assert checksums.times(checksums.power(77), checksums.power(-77)) == 1 << 31
