"""The standard security handler for reading (and RC4 for writing): keys, passwords, strings and streams.

Revisions 2 to 4 with RC4 or AES of 128 bits. AES runs over all blocks of a value at once; its tables follow from the field's rule.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: fixed value: the padding string of the file format's password algorithm
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, x in enumerate(data):
        i = (i + 1) & 255
        a = s[i]
        j = (j + a) & 255
        b = s[j]
        s[i], s[j] = b, a
        out[k] = x ^ s[(a + b) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    """The product in the field of 256 elements with the polynomial 0x11B."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _box() -> np.ndarray:
    inverse = [0] + [next(y for y in range(1, 256) if _times(x, y) == 1) for x in range(1, 256)]
    turn = lambda x, n: (x << n | x >> (8 - n)) & 255
    return np.array([x ^ turn(x, 1) ^ turn(x, 2) ^ turn(x, 3) ^ turn(x, 4) ^ 0x63 for x in inverse], np.uint8)


_tables: dict[str, np.ndarray] = {}


def tables() -> dict[str, np.ndarray]:
    if not _tables:
        box = _box()
        back = np.zeros(256, np.uint8)
        back[box] = np.arange(256)
        _tables.update({"box": box, "back": back, **{f"x{k}": np.array([_times(x, k) for x in range(256)], np.uint8) for k in (9, 11, 13, 14)}})
    return _tables


def round_keys(key: bytes) -> np.ndarray:
    box, n = tables()["box"], len(key) // 4
    words, constant = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if i % n == 0:
            w = [int(box[x]) for x in w[1:] + w[:1]]
            w[0] ^= constant
            constant = _times(constant, 2)
        elif n > 6 and i % n == 4:
            w = [int(box[x]) for x in w]
        words.append([a ^ b for a, b in zip(words[i - n], w, strict=True)])
    return np.array(words, np.uint8).reshape(-1, 16)


def aes_decrypt(key: bytes, data: bytes) -> bytes:
    """CBC with the first block as the vector; padding taken off."""
    if len(data) < 32 or len(data) % 16:
        return b""
    t, keys = tables(), round_keys(key)
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    s = blocks[1:] ^ keys[-1]
    order = np.array([(4 * ((i // 4 - i % 4) % 4)) + i % 4 for i in range(16)])  # rows turned back
    for k in range(len(keys) - 2, -1, -1):
        s = t["back"][s[:, order]] ^ keys[k]
        if k:
            c = s.reshape(-1, 4, 4)
            s = np.stack([t["x14"][c[:, :, r]] ^ t["x11"][c[:, :, (r + 1) % 4]] ^ t["x13"][c[:, :, (r + 2) % 4]] ^ t["x9"][c[:, :, (r + 3) % 4]] for r in range(4)], axis=2).reshape(-1, 16)
    plain = (s ^ blocks[:-1]).tobytes()
    return plain[: -plain[-1]] if 1 <= plain[-1] <= 16 else plain


def file_key(password: bytes, owner: bytes, permissions: int, first_id: bytes, revision: int, size: int, metadata: bool = True) -> bytes:
    h = hashlib.md5((password + PADDING)[:32] + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + first_id + (b"" if metadata or revision < 4 else b"\xff" * 4)).digest()
    for _ in range(50 if revision >= 3 else 0):
        h = hashlib.md5(h[:size]).digest()
    return h[:size]


def user_entry(key: bytes, first_id: bytes, revision: int) -> bytes:
    if revision == 2:
        return rc4(key, PADDING)
    out = hashlib.md5(PADDING + first_id).digest()
    for k in range(20):
        out = rc4(bytes(x ^ k for x in key), out)
    return out


def owner_key(password: bytes, revision: int, size: int) -> bytes:
    h = hashlib.md5((password + PADDING)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        h = hashlib.md5(h).digest()
    return h[:size]


def owner_entry(owner: bytes, user: bytes, revision: int, size: int) -> bytes:
    key, out = owner_key(owner, revision, size), (user + PADDING)[:32]
    for k in range(20 if revision >= 3 else 1):
        out = rc4(bytes(x ^ k for x in key), out)
    return out


class Handler:
    """Decrypts the objects of a file. head: the encryption dictionary, resolved."""

    def __init__(self, head: dict, first_id: bytes, password: bytes = b""):
        self.version, self.revision = int(head.get("V", 0)), int(head.get("R", 2))
        if head.get("Filter") != "Standard" or self.version not in (1, 2, 4):
            raise ValueError("security handler")
        size = int(head.get("Length", 40)) // 8 if self.version > 1 else 5
        method = "V2"
        if self.version == 4:
            size = 16
            f = (head.get("CF") or {}).get(str(head.get("StmF", "Identity")), {})
            method = str(f.get("CFM", "None"))
        self.method, self.permissions = method, int(head.get("P", -1))
        owner, self.user, meta = head["O"][:32], head["U"], head.get("EncryptMetadata", True) is not False
        self.key = b""
        back = owner
        key = owner_key(password, self.revision, size)
        for k in range(19, -1, -1) if self.revision >= 3 else (0,):
            back = rc4(bytes(x ^ k for x in key), back)
        for guess in (password, back):
            key = file_key(guess, owner, self.permissions, first_id, self.revision, size, meta)
            n = 32 if self.revision == 2 else 16
            if user_entry(key, first_id, self.revision)[:n] == self.user[:n]:
                self.key = key
                break

    def open(self, num: int, gen: int, data: bytes) -> bytes:
        if self.method in ("None", "Identity"):
            return data
        salt = b"sAlT" if self.method == "AESV2" else b""
        own = hashlib.md5(self.key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + salt).digest()[: min(16, len(self.key) + 5)]
        return aes_decrypt(own, data) if self.method == "AESV2" else rc4(own, data)
