"""OpenPGP messages under a passphrase: whole payloads, encrypted with AES-256 and a modification check.

Public-key messages and signatures need keys that no library here handles; they are an error that says so.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import hmac
import os
import re
import time
import zlib
from collections.abc import Iterator

import numpy as np

from ..errors import EngineError
from .aes import encrypt_blocks, round_keys

#: Packet tags, cipher key sizes, hash names, the octet that tells how much the passphrase is hashed, and the
#: header of the modification check (fixed by the message format).
PUBLIC_KEY_SESSION, PASSPHRASE_SESSION, COMPRESSED, LITERAL, PROTECTED = 1, 3, 8, 11, 18
KEY_SIZES, HASHES = {7: 16, 8: 24, 9: 32}, {2: "sha1", 8: "sha256", 9: "sha384", 10: "sha512", 11: "sha224"}
COUNT, CHECK_HEAD = 0x60, b"\xd3\x14"
_BLOCK = 16


def _key(passphrase: str, how: bytes, size: int) -> tuple[bytes, int]:
    """The key that a passphrase makes by a string-to-key specifier, and the specifier's length."""
    kind, name = how[0], HASHES.get(how[1])
    if name is None or kind not in (0, 1, 3):
        raise EngineError(f"string-to-key specifier {kind} with hash {how[1]} is not supported")
    salt, used = (how[2:10], 10) if kind else (b"", 2)
    data, octets = salt + passphrase.encode(), 0
    if kind == 3:
        octets, used = (16 + (how[10] & 15)) << ((how[10] >> 4) + 6), 11
    octets, out, zeros = max(octets, len(data)), b"", 0
    while len(out) < size:
        digest = hashlib.new(name, bytes(zeros))
        whole, rest = divmod(octets, len(data))
        for _ in range(whole):
            digest.update(data)
        digest.update(data[:rest])
        out, zeros = out + digest.digest(), zeros + 1
    return out[:size], used


def _feedback_encrypt(key: bytes, data: bytes) -> bytes:
    """Cipher feedback from a zero vector. Each block needs the one before, so this goes block by block."""
    keys, last, out = round_keys(key), np.zeros((1, _BLOCK), np.uint8), bytearray()
    for at in range(0, len(data), _BLOCK):
        part = np.frombuffer(data[at : at + _BLOCK], np.uint8)
        coded = part ^ encrypt_blocks(keys, last)[0, : len(part)]
        out += coded.tobytes()
        last = np.resize(coded, (1, _BLOCK))
    return bytes(out)


def _feedback_decrypt(key: bytes, data: bytes) -> bytes:
    """All blocks at once, as the blocks before them are there."""
    coded = np.frombuffer(data + bytes(-len(data) % _BLOCK), np.uint8).reshape(-1, _BLOCK)
    before = np.concatenate([np.zeros((1, _BLOCK), np.uint8), coded[:-1]])
    return (coded ^ encrypt_blocks(round_keys(key), before)).tobytes()[: len(data)]


def _packet(tag: int, body: bytes) -> bytes:
    return bytes([0xC0 | tag, 0xFF]) + len(body).to_bytes(4, "big") + body


def packets(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(tag, body) of a message's packets, in the old and the new format, with lengths in parts."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise EngineError("an OpenPGP packet ends too early")
        at += n
        return data[at - n : at]

    while at < len(data):
        head = take(1)[0]
        if not head & 0x80:
            raise EngineError("this is no OpenPGP message")
        if not head & 0x40:
            size = head & 3
            yield head >> 2 & 15, take(int.from_bytes(take(1 << size), "big") if size < 3 else len(data) - at)
            continue
        body, more = b"", True
        while more:
            n, more = take(1)[0], False
            if 224 <= n < 255:
                n, more = 1 << (n & 31), True
            elif n == 255:
                n = int.from_bytes(take(4), "big")
            elif n >= 192:
                n = (n - 192 << 8) + take(1)[0] + 192
            body += take(n)
        yield head & 63, body


def encrypt(data: bytes, passphrase: str, name: str = "", armor: bool = False) -> bytes:
    """An OpenPGP message that holds the data. Feedback goes block by block: a few hundred KB a second."""
    how = bytes([3, 8]) + os.urandom(8) + bytes([COUNT])
    key, _ = _key(passphrase, how, 32)
    title = name.encode()[:255]
    literal = _packet(LITERAL, b"b" + bytes([len(title)]) + title + int(time.time()).to_bytes(4, "big") + data)
    start = os.urandom(_BLOCK)
    plain = start + start[-2:] + literal + CHECK_HEAD
    out = _packet(PASSPHRASE_SESSION, bytes([4, 9]) + how) + _packet(PROTECTED, b"\1" + _feedback_encrypt(key, plain + hashlib.sha1(plain).digest()))
    return armored(out) if armor else out


def decrypt(message: bytes, passphrase: str) -> bytes:
    """The data of a message under a passphrase, armored or not, compressed or not."""
    if message.lstrip().startswith(b"-----BEGIN PGP MESSAGE"):
        message = unarmored(message)
    sessions, reason = [], "no passphrase opens this message"
    for tag, body in packets(message):
        if tag == PASSPHRASE_SESSION:
            sessions.append(body)
        elif tag == PUBLIC_KEY_SESSION:
            reason = "this message is for a public key, which needs a library that is not here"
        elif tag == PROTECTED:
            for session in sessions:
                if (plain := _opened(session, body, passphrase)) is not None:
                    return _content(plain)
            raise EngineError(f"{reason}, or its content was changed")
    raise EngineError("the message has no protected data")


def _opened(session: bytes, body: bytes, passphrase: str) -> bytes | None:
    """The packets inside, if the passphrase is right and nothing was changed."""
    if session[0] != 4 or session[1] not in KEY_SIZES or body[:1] != b"\1":
        raise EngineError("this kind of OpenPGP encryption is not supported")
    size = KEY_SIZES[session[1]]
    key, used = _key(passphrase, session[2:], size)
    if rest := session[2 + used :]:  # the session's key is itself encrypted
        inner = _feedback_decrypt(key, rest)
        if inner[0] not in KEY_SIZES or len(inner) != 1 + KEY_SIZES[inner[0]]:
            return None
        key = inner[1:]
    plain = _feedback_decrypt(key, body[1:])
    if plain[_BLOCK - 2 : _BLOCK] != plain[_BLOCK : _BLOCK + 2] or plain[-22:-20] != CHECK_HEAD:
        return None
    if not hmac.compare_digest(hashlib.sha1(plain[:-20]).digest(), plain[-20:]):
        return None
    return plain[_BLOCK + 2 : -22]


def _content(data: bytes) -> bytes:
    for tag, body in packets(data):
        if tag == COMPRESSED:
            ways = {0: bytes, 1: lambda b: zlib.decompress(b, -15), 2: zlib.decompress, 3: bz2.decompress}
            if body[0] not in ways:
                raise EngineError(f"compression {body[0]} is not supported")
            return _content(ways[body[0]](body[1:]))
        if tag == LITERAL:
            return body[6 + body[1] :]
    raise EngineError("the message holds no data")


def _checksum(data: bytes) -> bytes:
    """The armor's 24-bit cyclic redundancy check."""
    crc = 0xB704CE
    for byte in data:
        crc ^= byte << 16
        for _ in range(8):
            crc = crc << 1 ^ (0x1864CFB if crc & 0x800000 else 0)
    return (crc & 0xFFFFFF).to_bytes(3, "big")


def armored(data: bytes) -> bytes:
    text = base64.b64encode(data)
    lines = [text[i : i + 64] for i in range(0, len(text), 64)]
    return b"\n".join([b"-----BEGIN PGP MESSAGE-----", b"", *lines, b"=" + base64.b64encode(_checksum(data)), b"-----END PGP MESSAGE-----", b""])


def unarmored(text: bytes) -> bytes:
    m = re.search(rb"-----BEGIN PGP MESSAGE-----\r?\n(?:[^\r\n]+: [^\r\n]*\r?\n)*\r?\n(.*?)(?:\n=([\w+/]{4}))?\r?\n-----END PGP MESSAGE-----", text, re.S)
    if not m:
        raise EngineError("the armor is torn")
    data = base64.b64decode(m[1])
    if m[2] and base64.b64decode(m[2]) != _checksum(data):
        raise EngineError("the armor's checksum is wrong")
    return data
