"""Schemas and the fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

POINTS = T.ArrayType(T.ArrayType(T.DoubleType()))

DETECTION = T.StructType(
    [
        T.StructField("class_name", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("kind", T.StringType()),
        T.StructField("box", T.ArrayType(T.DoubleType())),
        T.StructField("mask", POINTS),
        T.StructField("keypoints", POINTS),
        T.StructField("class_id", T.IntegerType()),
        T.StructField("track_id", T.IntegerType()),
    ]
)

#: One scored image, as a scorer returns it.
RESULT = T.StructType(
    [
        T.StructField("task", T.StringType()),
        T.StructField("preprocess_ms", T.DoubleType()),
        T.StructField("inference_ms", T.DoubleType()),
        T.StructField("postprocess_ms", T.DoubleType()),
        T.StructField("device", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("detections", T.ArrayType(DETECTION)),
    ]
)

# Numbers that documents also write as text or with a fraction are read as text first.
COCO_IMAGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("width", T.StringType()),
        T.StructField("height", T.StringType()),
    ]
)
COCO_ANNOTATION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("image_id", T.StringType()),
        T.StructField("category_id", T.StringType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("segmentation", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("keypoints", T.ArrayType(T.DoubleType())),
        T.StructField("num_keypoints", T.IntegerType()),
    ]
)
COCO_CATEGORY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("keypoints", T.ArrayType(T.StringType())),
    ]
)
COCO_DOCUMENT = T.StructType(
    [
        T.StructField("images", T.ArrayType(COCO_IMAGE)),
        T.StructField("annotations", T.ArrayType(COCO_ANNOTATION)),
        T.StructField("categories", T.ArrayType(COCO_CATEGORY)),
    ]
)

# Results only agree with other tools when these do.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "tiff", "tif")
SKIPPED_FOLDERS = (
    ".git", ".svn", "__pycache__", "node_modules", ".ipynb_checkpoints",
    ".thumbnails", "$RECYCLE.BIN", "System Volume Information",
)
KINDS = ("agreed", "reclassified", "missing", "added")
DEFAULT_IOU = 0.5
MAX_TILES = 256
DEFAULT_PAGE = 200
MAX_PAGE = 1000
SCORING_BATCH = 16
THUMBNAIL_EDGE = 480
FALLBACK_FPS = 25.0
TOP_K = 5
FORMATS_BY_TASK = {
    "detect": "coco",
    "segment": "coco",
    "obb": "coco",
    "pose": "coco_keypoints",
    "classify": "imagenet",
}
FORMAT_LABELS = {
    "coco": "COCO 1.0",
    "coco_keypoints": "COCO Keypoints 1.0",
    "imagenet": "ImageNet folders",
}
LABEL_STUDIO_CONTROLS = {
    "detect": ("RectangleLabels", "rectanglelabels"),
    "obb": ("RectangleLabels", "rectanglelabels"),
    "segment": ("PolygonLabels", "polygonlabels"),
    "pose": ("KeyPointLabels", "keypointlabels"),
    "classify": ("Choices", "choices"),
}
CVAT_SHAPES = {"segment": "polygon", "pose": "points"}
TRAINING_METRICS = {
    "map50": "metrics/mAP50(B)",
    "map": "metrics/mAP50-95(B)",
    "precision": "metrics/precision(B)",
    "recall": "metrics/recall(B)",
}
