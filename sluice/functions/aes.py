"""AES by numpy, for archive members that no library here opens: whole runs of blocks at once, in counter mode."""

from __future__ import annotations

import hashlib
import hmac
import struct
import zipfile
import zlib

import numpy as np

from ..errors import EngineError


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The substitution box by its rule (inverse in GF(256), then the affine map), and doubling in GF(256)."""
    doubled = np.array([(x << 1) ^ (0x11B if x & 0x80 else 0) for x in range(256)], np.uint8)
    power, log, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= int(doubled[x])  # times 3, which generates the field
    box = []
    for x in range(256):
        b = power[-log[x] % 255] if x else 0
        s = 0x63
        for shift in range(5):
            s ^= (b << shift | b >> (8 - shift)) & 0xFF
        box.append(s)
    return np.array(box, np.uint8), doubled


BOX, DOUBLED = _tables()
_SHIFTED = np.array([(4 * (c + r) + r) % 16 for c in range(4) for r in range(4)])


def round_keys(key: bytes) -> np.ndarray:
    words, n = [np.frombuffer(key[i : i + 4], np.uint8) for i in range(0, len(key), 4)], len(key) // 4
    if n not in (4, 6, 8):
        raise EngineError(f"an AES key has 16, 24 or 32 bytes, not {len(key)}")
    constant = 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = BOX[np.roll(w, -1)] ^ np.array([constant, 0, 0, 0], np.uint8)
            constant = int(DOUBLED[constant])
        elif n == 8 and i % n == 4:
            w = BOX[w]
        words.append(words[i - n] ^ w)
    return np.concatenate(words).reshape(-1, 16)


def encrypt_blocks(keys: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Rows of 16 bytes, each encrypted by itself."""
    state = blocks ^ keys[0]
    for i, key in enumerate(keys[1:], 1):
        state = BOX[state][:, _SHIFTED]
        if i < len(keys) - 1:
            a = state.reshape(-1, 4, 4)
            mixed = DOUBLED[a ^ np.roll(a, -1, axis=2)] ^ a ^ a[:, :, :1] ^ a[:, :, 1:2] ^ a[:, :, 2:3] ^ a[:, :, 3:]
            state = mixed.reshape(-1, 16)
        state = state ^ key
    return state


def counter_mode(key: bytes, data: bytes, blocks_at_once: int = 1 << 16) -> bytes:
    """data under the key stream of a little-endian counter that starts at 1; the same call undoes it."""
    keys, out, count = round_keys(key), [], -(-len(data) // 16)
    for first in range(0, count, blocks_at_once):
        numbers = np.arange(first + 1, min(first + blocks_at_once, count) + 1, dtype="<u8")
        blocks = np.zeros((len(numbers), 16), np.uint8)
        blocks[:, :8] = numbers.view(np.uint8).reshape(-1, 8)
        part = np.frombuffer(data, np.uint8)[first * 16 : (first + len(numbers)) * 16]
        out.append((part ^ encrypt_blocks(keys, blocks).ravel()[: len(part)]).tobytes())
    return b"".join(out)


#: Salt and key sizes by strength of the AES extra field, its id, and the rounds of key derivation (fixed by the format).
STRENGTHS, EXTRA_ID, ROUNDS = {1: (8, 16), 2: (12, 24), 3: (16, 32)}, 0x9901, 1000


def zip_keys(password: str, salt: bytes, size: int) -> tuple[bytes, bytes, bytes]:
    """(encryption key, authentication key, check value) of a ZIP member."""
    made = hashlib.pbkdf2_hmac("sha1", password.encode(), salt, ROUNDS, 2 * size + 2)
    return made[:size], made[size : 2 * size], made[2 * size :]


def unlocked_zip_member(file, info: zipfile.ZipInfo, password: str | None) -> bytes:
    """The content of an AES-encrypted member; a wrong password or changed bytes are an error."""
    extra, field = info.extra, b""
    while len(extra) >= 4:
        kind, size = struct.unpack("<HH", extra[:4])
        if kind == EXTRA_ID:
            field = extra[4 : 4 + size]
        extra = extra[4 + size :]
    if len(field) < 7 or field[4] not in STRENGTHS:
        raise EngineError(f"{info.filename}: the AES field is missing")
    if password is None:
        raise EngineError(f"{info.filename} is encrypted and no password is given")
    version, strength, method = struct.unpack("<H", field[:2])[0], field[4], struct.unpack("<H", field[5:7])[0]
    file.seek(info.header_offset + 26)
    name_size, extra_size = struct.unpack("<HH", file.read(4))
    file.seek(info.header_offset + 30 + name_size + extra_size)
    data, (salt_size, key_size) = file.read(info.compress_size), STRENGTHS[strength]
    salt, check, body, seal = data[:salt_size], data[salt_size : salt_size + 2], data[salt_size + 2 : -10], data[-10:]
    key, mac, expected = zip_keys(password, salt, key_size)
    if check != expected or not hmac.compare_digest(hmac.new(mac, body, "sha1").digest()[:10], seal):
        raise EngineError(f"{info.filename}: wrong password or changed content")
    plain = counter_mode(key, body)
    plain = plain if method == 0 else zlib.decompress(plain, -15)
    if version == 1 and zlib.crc32(plain) != info.CRC:
        raise EngineError(f"{info.filename}: bad checksum")
    return plain
