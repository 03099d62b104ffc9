"""Writes small stores byte by byte, sharing nothing with the reader."""

import os
import struct
import uuid
import zlib

NUL_ID = uuid.UUID(int=0)


def data_id(k):
    return uuid.UUID(f"00000000-0000-4000-a000-{k:012d}")


def bulk_id(k):
    return uuid.UUID(f"00000000-0000-4000-b000-{k:012d}")


def name_hash(name):
    h = 0
    raw = name.encode("utf-16-be")
    for k in range(0, len(raw), 2):
        h = (h * 31 + int.from_bytes(raw[k : k + 2], "big")) & 0xFFFFFFFF
    return ((h ^ 0xDEECE66D) * 0xDEECE66D + 0xB) & 0xFFFFFFFF


class Segment:
    """Collects records; a record is (type, bytes), a reference (segment, number)."""

    def __init__(self, identifier, generation=(1, 1, False)):
        self.id, self.generation, self.records, self.others = identifier, generation, [], []

    def add(self, kind, body):
        self.records.append((kind, body))
        return self.id, len(self.records) - 1

    def ref(self, record):
        segment, number = record
        if segment == self.id:
            return struct.pack(">Hi", 0, number)
        if segment not in self.others:
            self.others.append(segment)
        return struct.pack(">Hi", self.others.index(segment) + 1, number)

    def text(self, value):
        raw = value.encode()
        if len(raw) < 128:
            return self.add(4, bytes([len(raw)]) + raw)
        return self.add(4, struct.pack(">H", 0x8000 | (len(raw) - 128)) + raw)

    def long_text(self, value, bulk):
        raw = value.encode()
        blocks = [bulk.block(raw[k : k + 4096]) for k in range(0, len(raw), 4096)]
        return self.add(4, struct.pack(">Q", (len(raw) - 16512) | 0b11 << 62) + self.ref(self.list_of(blocks)))

    def external(self, identifier):
        raw = identifier.encode()
        return self.add(8, struct.pack(">H", 0xE000 | len(raw)) + raw)

    def list_of(self, items):
        while len(items) > 1:
            items = [self.add(2, b"".join(map(self.ref, items[k : k + 255]))) if len(items[k : k + 255]) > 1 else items[k] for k in range(0, len(items), 255)]
        return items[0]

    def counted(self, items):
        return self.add(3, struct.pack(">i", len(items)) + (self.ref(self.list_of(items)) if items else b""))

    def map_of(self, children, level=0):
        entries = sorted((name_hash(n), n, c) for n, c in children.items())
        if len(entries) > 32 and level < 7:
            buckets = {}
            for h, n, c in entries:
                shift = (32 - (level + 1) * 5) & 31
                signed = h - 2**32 if h >= 2**31 else h
                buckets.setdefault(signed >> shift & 31, {})[n] = c
            bitmap = sum(1 << b for b in buckets)
            return self.add(1, struct.pack(">II", level << 29 | len(entries), bitmap) + b"".join(self.ref(self.map_of(buckets[b], level + 1)) for b in sorted(buckets)))
        pairs = [(self.text(n), c) for _, n, c in entries]
        return self.add(0, struct.pack(">I", level << 29 | len(entries)) + b"".join(struct.pack(">I", h) for h, *_ in entries) + b"".join(self.ref(k) + self.ref(v) for k, v in pairs))

    def overlay(self, name, value, base):
        return self.add(0, struct.pack(">II", 0xFFFFFFFF, name_hash(name)) + self.ref(self.text(name)) + self.ref(value) + self.ref(base))

    def node(self, children=None, properties=(), primary=None, mixins=(), child_map=None):
        """Properties are (name, tag, record) or (name, -tag, records)."""
        children = children or {}
        head = (primary is not None) << 31 | bool(mixins) << 30 | len(mixins) << 18 | len(properties)
        names = b"".join(self.ref(self.text(n)) for n in ([primary] if primary is not None else []) + list(mixins))
        many = child_map is not None or len(children) > 1
        if many:
            head |= 1 << 28
        elif not children:
            head |= 1 << 29
        else:
            names += self.ref(self.text(next(iter(children))))
        if properties:
            names += self.ref(self.list_of([self.text(n) for n, *_ in properties]))
        template = self.add(6, struct.pack(">I", head) + names + bytes(t & 0xFF for _, t, _ in properties))
        body = self.ref((self.id, len(self.records))) + self.ref(template)
        if many:
            child_map = child_map or self.map_of(children)
        values = self.list_of([v if t > 0 else self.counted(v) for _, t, v in properties]) if properties else None
        body = self.ref((self.id, len(self.records))) + self.ref(template)
        if many:
            body += self.ref(child_map)
        elif children:
            body += self.ref(next(iter(children.values())))
        if values:
            body += self.ref(values)
        return self.add(7, body)

    def content(self):
        bodies, offset, table = b"", 262144, []
        for number, (kind, body) in enumerate(self.records):
            body += b"\0" * (-len(body) % 4)
            offset -= len(body)
            bodies = body + bodies
            table.append((number, kind, offset))
        g, f, c = self.generation
        head = b"0aK" + bytes([13]) + struct.pack(">I", f | c << 31) + b"\0\0" + struct.pack(">iii", g, len(self.others), len(table)) + b"\0" * 10
        head += b"".join(o.bytes for o in self.others) + b"".join(struct.pack(">iBi", *t) for t in table)
        return head + b"\0" * (-(len(head) + len(bodies)) % 16) + bodies


class Bulk:
    def __init__(self, identifier):
        self.id, self.blocks, self.generation, self.others = identifier, [], (0, 0, False), []

    def block(self, raw):
        self.blocks.append(raw)
        return self.id, 262144 - 4096 * len(self.blocks)

    def content(self):
        return b"".join(b + b"\0" * (4096 - len(b)) for b in reversed(self.blocks))


def header(name, size):
    h = name.encode().ljust(100, b"\0") + b"0000400\0" + b"0000000\0" * 2 + f"{size:011o}\0".encode() + b"00000000000\0" + b" " * 8 + b"0"
    h = h.ljust(512, b"\0")
    return h[:148] + f"{sum(h):06o}\0 ".encode() + h[156:]


def entry(name, raw):
    return header(name, len(raw)) + raw + b"\0" * (-len(raw) % 512)


def trailer(name, raw, count, magic, declared_is_padded=False):
    pad = -(len(raw) + 16) % 512
    size = len(raw) + 16 + (pad if declared_is_padded else 0)
    body = b"\0" * pad + raw + struct.pack(">IiiI", zlib.crc32(raw), count, size, magic)
    return header(name, len(body)) + body


def archive(path, segments, index=True, graph=True, binaries=()):
    out, rows = b"", []
    for s in segments:
        raw = s.content()
        rows.append((s, len(out) + 512, len(raw)))
        out += entry(f"{s.id}.{zlib.crc32(raw):08x}", raw)
    name = os.path.basename(path)
    if binaries:
        raw = struct.pack(">iiBi", 1, 1, 0, len(binaries))
        for s, ids in binaries:
            raw += s.id.bytes + struct.pack(">i", len(ids)) + b"".join(struct.pack(">i", len(i)) + i.encode() for i in ids)
        out += trailer(name + ".brf", raw, 1, 0x0A31420A)
    if graph:
        raw = b"".join(s.id.bytes + struct.pack(">i", len(s.others)) + b"".join(o.bytes for o in s.others) for s in segments if s.others)
        out += trailer(name + ".gph", raw, sum(bool(s.others) for s in segments), 0x0A30470A)
    if index:
        signed = lambda x: struct.unpack(">qq", x[0].id.bytes)
        raw = b"".join(s.id.bytes + struct.pack(">iiiiB", at, n, s.generation[0], s.generation[1], s.generation[2]) for s, at, n in sorted(rows, key=signed))
        out += trailer(name + ".idx", raw, len(rows), 0x0A314B0A, declared_is_padded=True)
    with open(path, "wb") as f:
        f.write(out + b"\0" * 1024)
