"""Small hand-made plans as tables."""

V = "unit_id string, vertex_id string, x double, y double"
W = "unit_id string, wall_id string, pos int, a string, b string, thickness double, height double, stands_alone boolean"
L = "unit_id string, label_id string, pos int, name string, kind string, x double, y double, flat string, printed_size string"
O = "unit_id string, wall_id string, opening_id string, kind string, off double, width double"
C = "unit_id string, pillar_id string, x double, y double, w double, h double"


class Plan:
    """Collects corners, walls, labels and openings of several units."""

    def __init__(self):
        self.v, self.w, self.l, self.o, self.c = [], [], [], [], []

    def corner(self, u, i, x, y):
        self.v.append((u, i, float(x), float(y)))

    def wall(self, u, i, a, b, height=3.0, thickness=0.1, alone=False):
        self.w.append((u, i, len(self.w), a, b, thickness, height, alone))

    def label(self, u, i, name, kind, x, y, flat=None, size=None):
        self.l.append((u, i, len(self.l), name, kind, float(x), float(y), flat, size))

    def opening(self, u, wall, i, kind, off, width):
        self.o.append((u, wall, i, kind, float(off), float(width)))

    def column(self, u, i, x, y, w, h):
        self.c.append((u, i, float(x), float(y), float(w), float(h)))

    def rect(self, u, x0, y0, w, h, tag=""):
        pts = [(x0, y0), (x0 + w, y0), (x0 + w, y0 + h), (x0, y0 + h)]
        ids = [f"{tag}{i}" for i in range(4)]
        for i, (x, y) in zip(ids, pts):
            self.corner(u, i, x, y)
        for k in range(4):
            self.wall(u, f"{tag}w{k}", ids[k], ids[(k + 1) % 4])

    def row_of_boxes(self, u, n, size=4.0, kinds=None, doors=()):
        """n boxes side by side sharing walls s0…sn; ``doors``: shared walls with a door."""
        for k in range(n + 1):
            self.corner(u, f"t{k}", k * size, 0)
            self.corner(u, f"b{k}", k * size, size)
            self.wall(u, f"s{k}", f"t{k}", f"b{k}")
        for k in range(n):
            self.wall(u, f"n{k}", f"t{k}", f"t{k + 1}")
            self.wall(u, f"z{k}", f"b{k}", f"b{k + 1}")
            if kinds:
                name, kind = kinds[k]
                self.label(u, f"r{k}", name, kind, k * size + size / 2, size / 2)
        for d in doors:
            self.opening(u, f"s{d}", f"d{d}", "door", 1.5, 0.9)

    def tables(self, spark):
        make = spark.createDataFrame
        return make(self.v, V), make(self.w, W), make(self.l, L), make(self.o, O), make(self.c, C)
