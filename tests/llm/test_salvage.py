"""Salvage inside gzip members."""

import base64
import gzip
import hashlib
import random

from kinledger.llm import warc


def _records(n):
    rng = random.Random(6)
    payloads = [b"%d " % i + bytes(rng.randrange(256) for _ in range(300)) for i in range(n)]
    return [warc.record(i, "u", p, base64.b32encode(hashlib.sha1(p).digest()).decode(), None) for i, p in enumerate(payloads)]


def _ids(data):
    found = list(warc.salvage(data))
    return [int(r["fields"]["warc-record-id"].strip("<>").rsplit(":", 1)[1]) for _, _, r, _ in found if r], [(s, e, why) for s, e, r, why in found if not r]


def test_a_bad_record_costs_itself_alone():
    one = _records(6)
    one[2] = one[2].replace(b"\r\n\r\n2 ", b"\r\n\r\n3 ")  # the digest differs
    member = gzip.compress(b"".join(one))
    start = len(one[0]) + len(one[1])
    assert _ids(member) == ([0, 1, 3, 4, 5], [(0, len(member), f"digest differs, bytes {start} to {start + len(one[2])} of the content")])
    more = gzip.compress(b"".join(_records(2)))
    assert _ids(member + more)[0] == [0, 1, 3, 4, 5, 0, 1]


def test_what_inflates_of_a_damaged_member_is_kept():
    one, next_ = _records(6), gzip.compress(_records(1)[0])
    member = gzip.compress(b"".join(one))
    crc = bytearray(member)
    crc[-8] ^= 1
    ids, gaps = _ids(bytes(crc) + next_)
    assert ids == [0, 1, 2, 3, 4, 5, 0] and gaps[0][:2] == (0, len(member)) and len(gaps) == 1
    ids, gaps = _ids(member[: len(member) * 2 // 3])
    assert ids[:3] == [0, 1, 2] and 5 not in ids and len(gaps) == 1
    ids, _ = _ids(member[: len(member) * 2 // 3] + next_)
    assert ids[:3] == [0, 1, 2] and ids[-1] == 0
    stored = gzip.compress(b"".join(one), 0)  # plain text in the member isn't read twice
    broken = bytearray(stored)
    broken[-8] ^= 1
    assert _ids(bytes(broken))[0] == [0, 1, 2, 3, 4, 5]


def test_unchecked_bytes_need_a_digest():
    bare = gzip.compress(_records(1)[0].replace(b"WARC-Payload-Digest: sha1:", b"X-None: "))
    bad = bytearray(bare)
    bad[-8] ^= 1
    assert _ids(bare)[0] == [0] and _ids(bytes(bad)) == ([], [(0, len(bad), _ids(bytes(bad))[1][0][2])])


def test_bad_numbers_are_damage():
    one = _records(3)
    for bad in ("\u00b2".encode(), b"9" * 5000, b"-1", b"", b"1 2"):
        wrong = b"".join([one[1].split(b"\r\nContent-Length: ")[0], b"\r\nContent-Length: ", bad, b"\r\n\r\n", one[1].split(b"\r\n\r\n", 1)[1]])
        found = list(warc.salvage(one[0] + wrong + one[2]))
        assert [r["fields"]["warc-record-id"][-2:-1] for _, _, r, _ in found if r] == ["0", "2"]
        assert all(r["payload_bytes"] < 2**63 for _, _, r, _ in found if r)
    http = _records(1)[0].replace(b"Content-Type: text/html; charset=utf-8\r\nContent-Length: ", b"Content-Type: text/html; charset=utf-8\r\nContent-Length: 99999999999999999999")
    assert all(r is None or r["payload_bytes"] < 2**63 for _, _, r, _ in warc.salvage(http))


def test_many_false_marks_take_linear_time():
    import time

    tail = b"x" * 2_000_000 + gzip.compress(_records(1)[0])
    for false in (b"\x1f\x8b\x08zz" * 4000, b"WARC/1.1\r\na: b\r\n" * 4000, b"\x1f\x8b\x08WARC/1.1\r\n" * 4000):
        began = time.time()
        assert _ids(false + tail)[0] == [0] and time.time() - began < 10
