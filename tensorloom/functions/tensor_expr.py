"""Array-valued tensor expressions; a tensor is a row-major ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tensorloom.functions.cols import col, let, whole_div
from tensorloom.functions.draws import coin, uniform

# The example pipeline's 3x4 weights and the image channel statistics.
PIPELINE_WEIGHTS = ((1.0, 0.0, 0.5, 0.0), (0.0, 1.0, 0.0, 0.5), (1.0, 1.0, 1.0, 1.0))
IMAGE_MEAN = (0.485, 0.456, 0.406)
IMAGE_STD = (0.229, 0.224, 0.225)
U32 = 4294967296


def doubles(values: Column | str) -> Column:
    return col(values).cast("array<double>")


def constants(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def matmul(values: Column | str, weights) -> Column:
    """[rows, k] times a small literal [k, n]; the row count comes from the array."""
    inner = len(weights)
    columns = list(zip(*weights))

    def product(values: Column) -> Column:
        def one_row(row: Column) -> Column:
            cells = [F.element_at(values, (row * inner + k + 1).cast("int")) for k in range(inner)]
            return F.array(
                *[sum((cells[k] * F.lit(w[k]) for k in range(1, inner)), cells[0] * F.lit(w[0])) for w in columns]
            )

        rows = F.sequence(F.lit(0), (F.size(values) / inner).cast("int") - 1)
        return F.when(F.size(values) == 0, F.array().cast("array<double>")).otherwise(
            F.flatten(F.transform(rows, one_row))
        )

    return let(values, product)


def scale(values: Column | str, factor: float) -> Column:
    return F.transform(col(values), lambda x: x * F.lit(factor))


def relu(values: Column | str) -> Column:
    return F.transform(col(values), lambda x: F.greatest(x, F.lit(0.0)))


def first_half(values: Column | str) -> Column:
    return let(values, lambda v: F.slice(v, F.lit(1), (F.size(v) / 2).cast("int")))


def add_one_u32(values: Column | str) -> Column:
    return F.transform(col(values), lambda x: F.pmod(x.cast("bigint") + 1, F.lit(U32)))


def log_sum_exp(logits: Column | str) -> Column:
    return let(
        logits,
        lambda a: let(F.array_max(a), lambda peak: peak + F.ln(total(F.transform(a, lambda x: F.exp(x - peak))))),
    )


def log_softmax(logits: Column | str) -> Column:
    return let(
        logits, lambda a: let(log_sum_exp(a), lambda norm: F.transform(a, lambda x: x - norm))
    )


def cross_entropy(logits: Column | str, target: Column | str) -> Column:
    return let(logits, lambda a: log_sum_exp(a) - F.element_at(a, (col(target) + 1).cast("int")))


def predicted_class(logits: Column | str) -> Column:
    """Index of the largest logit; the first one wins a tie."""
    return let(logits, lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def element_count(shape: Column | str) -> Column:
    return F.aggregate(col(shape), F.lit(1).cast("bigint"), lambda acc, n: acc * n)


def count_fits(shape: Column | str, values: Column | str) -> Column:
    return element_count(shape) == F.size(col(values)).cast("bigint")


def spatial_mean(values: Column | str, channels: int, height: int, width: int) -> Column:
    """Mean over width, then over height, of a CHW tensor."""
    lines = F.sequence(F.lit(0), F.lit(height - 1))

    def pooled(values: Column) -> Column:
        def line(c: Column, y: Column) -> Column:
            start = (c * height + y) * width + 1
            return total(F.slice(values, start.cast("int"), F.lit(width))) / F.lit(float(width))

        return F.transform(
            F.sequence(F.lit(0), F.lit(channels - 1)),
            lambda c: total(F.transform(lines, lambda y: line(c, y))) / F.lit(float(height)),
        )

    return let(values, pooled)


def max_pool_3x3(values: Column | str, height: int, width: int) -> Column:
    """3x3 maximum, stride 2, edge padded by one, of one HW plane.

    A padded cell repeats a cell of the same window, so clipping the window to
    the plane gives the same maximum.
    """
    out_width = (width + 1) // 2
    taps = []
    for y in range((height + 1) // 2):
        for x in range(out_width):
            rows = range(max(2 * y - 1, 0), min(2 * y + 2, height))
            cols = range(max(2 * x - 1, 0), min(2 * x + 2, width))
            taps.append(F.array(*[F.lit(r * width + c + 1) for r in rows for c in cols]))

    def pooled(values: Column) -> Column:
        return F.transform(
            F.array(*taps),
            lambda window: F.array_max(F.transform(window, lambda i: F.element_at(values, i))),
        )

    return let(values, pooled)


def normalise_hwc(pixels: Column | str, height: int, width: int) -> Column:
    """0..255 HWC pixels to normalised CHW values."""
    plane = height * width
    cells = F.sequence(F.lit(0), F.lit(plane - 1))

    def channels(image: Column) -> Column:
        def plane_of(c: int) -> Column:
            return F.transform(
                cells,
                lambda p: (
                    F.element_at(image, (p * 3 + c + 1).cast("int")).cast("double") / F.lit(255.0)
                    - F.lit(IMAGE_MEAN[c])
                )
                / F.lit(IMAGE_STD[c]),
            )

        return F.concat(*[plane_of(c) for c in range(3)])

    return let(pixels, channels)


def denormalise_chw(values: Column | str, plane: int) -> Column:
    """Normalised CHW values back to 0..255 integers, in CHW order."""
    mean, std = constants(IMAGE_MEAN), constants(IMAGE_STD)

    def cell(v: Column, i: Column) -> Column:
        channel = F.floor(i / plane).cast("int") + 1
        raw = v * F.element_at(std, channel) + F.element_at(mean, channel)
        return F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")

    return F.transform(col(values), cell)


def flip_rows(values: Column | str, width: int, gate: Column) -> Column:
    """Mirror every width-long line where the gate holds."""

    def mirrored(v: Column) -> Column:
        lines = F.sequence(F.lit(0), (F.size(v) / width).cast("int") - 1)
        return F.flatten(
            F.transform(lines, lambda r: F.reverse(F.slice(v, (r * width + 1).cast("int"), F.lit(width))))
        )

    return F.when(gate, let(values, mirrored)).otherwise(col(values))


def random_flip(values: Column | str, width: int, seed: int, key: Column | str) -> Column:
    return flip_rows(values, width, coin(f"{seed}:flip", key))


def crop_box(seed: int, key: Column | str, height: int, width: int) -> Column:
    """Random crop (x, y, width, height, attempt); attempt 0 is the centred square."""
    area = float(height * width)

    def attempt(i: Column) -> Column:
        def draw(part: str) -> Column:
            return uniform(f"{seed}:{part}", key, i)

        target = F.lit(area) * (F.lit(0.08) + draw("area") * F.lit(0.92))
        ratio = F.lit(3.0 / 4.0) + draw("ratio") * F.lit(4.0 / 3.0 - 3.0 / 4.0)
        w = F.round(F.sqrt(target * ratio)).cast("int")
        h = F.round(F.sqrt(target / ratio)).cast("int")
        return F.struct(
            F.floor(draw("x") * (F.lit(width) - w + 1)).cast("int").alias("x"),
            F.floor(draw("y") * (F.lit(height) - h + 1)).cast("int").alias("y"),
            w.alias("width"),
            h.alias("height"),
            i.cast("int").alias("attempt"),
        )

    tries = F.filter(
        F.transform(F.sequence(F.lit(1), F.lit(10)), attempt),
        lambda b: b["width"].between(1, width) & b["height"].between(1, height),
    )
    side = min(height, width)
    centred = F.struct(
        F.lit((width - side) // 2).alias("x"),
        F.lit((height - side) // 2).alias("y"),
        F.lit(side).alias("width"),
        F.lit(side).alias("height"),
        F.lit(0).alias("attempt"),
    )
    return F.when(F.size(tries) > 0, F.element_at(tries, 1)).otherwise(centred)


def reshape_index(flat: Column | str, shape) -> list[Column]:
    """Coordinates of a flat row-major position."""
    rest, out = col(flat), []
    for size in reversed(shape):
        out.append(F.pmod(rest, F.lit(size)).cast("int"))
        rest = whole_div(rest, size)
    return out[::-1]
