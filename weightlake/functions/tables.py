"""Fixed values of the formats read: element widths, storage classes, block types."""

# fixed values: tensor dtype -> bytes of an element; others count as single bytes
DTYPE_WIDTH = {
    "BOOL": 1, "U8": 1, "I8": 1, "F8_E4M3": 1, "F8_E5M2": 1, "F8_E8M0": 1, "F4": 1, "F6_E2M3": 1, "F6_E3M2": 1,
    "I16": 2, "U16": 2, "F16": 2, "BF16": 2, "I32": 4, "U32": 4, "F32": 4, "I64": 8, "U64": 8, "F64": 8,
}

# fixed values: torch storage class -> (dtype, bytes of an element)
TORCH_STORAGE = {
    "DoubleStorage": ("F64", 8), "FloatStorage": ("F32", 4), "HalfStorage": ("F16", 2), "BFloat16Storage": ("BF16", 2),
    "LongStorage": ("I64", 8), "IntStorage": ("I32", 4), "ShortStorage": ("I16", 2), "CharStorage": ("I8", 1),
    "ByteStorage": ("U8", 1), "BoolStorage": ("BOOL", 1), "ComplexFloatStorage": ("C64", 8), "ComplexDoubleStorage": ("C128", 8),
}

# fixed values: ggml type id -> (name, elements of a block, bytes of a block)
GGML = {
    0: ("F32", 1, 4), 1: ("F16", 1, 2), 2: ("Q4_0", 32, 18), 3: ("Q4_1", 32, 20), 6: ("Q5_0", 32, 22), 7: ("Q5_1", 32, 24),
    8: ("Q8_0", 32, 34), 9: ("Q8_1", 32, 36), 10: ("Q2_K", 256, 84), 11: ("Q3_K", 256, 110), 12: ("Q4_K", 256, 144), 13: ("Q5_K", 256, 176),
    14: ("Q6_K", 256, 210), 15: ("Q8_K", 256, 292), 16: ("IQ2_XXS", 256, 66), 17: ("IQ2_XS", 256, 74), 18: ("IQ3_XXS", 256, 98), 19: ("IQ1_S", 256, 50),
    20: ("IQ4_NL", 32, 18), 21: ("IQ3_S", 256, 110), 22: ("IQ2_S", 256, 82), 23: ("IQ4_XS", 256, 136), 24: ("I8", 1, 1), 25: ("I16", 1, 2),
    26: ("I32", 1, 4), 27: ("I64", 1, 8), 28: ("F64", 1, 8), 29: ("IQ1_M", 256, 56), 30: ("BF16", 1, 2), 34: ("TQ1_0", 256, 54), 35: ("TQ2_0", 256, 66),
}

# fixed values: ggml type id -> widths of a block's fields, in order
BLOCK_FIELDS = {
    2: (2, 16), 3: (2, 2, 16), 6: (2, 4, 16), 7: (2, 2, 4, 16), 8: (2, 32), 9: (2, 2, 32), 10: (16, 64, 2, 2), 11: (32, 64, 12, 2),
    12: (2, 2, 12, 128), 13: (2, 2, 12, 32, 128), 14: (128, 64, 16, 2), 16: (2, 64), 17: (2, 64, 8), 18: (2, 96), 19: (2, 32, 16),
    20: (2, 16), 21: (2, 64, 8, 32, 4), 22: (2, 64, 8, 8), 23: (2, 2, 4, 128), 29: (32, 16, 8), 34: (48, 4, 2), 35: (64, 2),
}

#: Region kinds.
BYTES, BF16, REF, BLOCK, DELTA = range(5)
