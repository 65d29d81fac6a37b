"""Users, resources and manipulations (comments) from text-valued records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stalemark.schemas import DATE_FORMAT, ENTITIES, TIMESTAMP_FORMAT

# Fields that hold pictures.
PICTURES = ("pic", "tpic")


def load_entities(raw: DataFrame, entity: str, insert_image: bool = False) -> DataFrame:
    """Records of one entity, typed; ``raw`` has the id in ``entity_id`` and any of the entity's fields as text.

    Fields not in the schema are kept as they are, absent ones are null, pictures are dropped unless asked for, and a new
    user starts with empty friend lists.
    """
    id_field, schema = ENTITIES[entity]
    given = {c.lower(): c for c in raw.columns if c != "entity_id"}
    columns = []
    for field in schema:
        source = given.pop(field.name.lower(), None)
        if field.name == id_field:
            column = F.col("entity_id").try_cast(field.dataType)
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array().cast(field.dataType)
        elif field.name in PICTURES and not insert_image:
            continue
        elif source is None:
            column = F.lit(None).cast(field.dataType)
        else:
            column = _typed(F.col(source), field.dataType)
        columns.append(column.alias(field.name))
    extra = [F.col(source) for source in given.values()]
    return raw.select(*columns, *extra)


def _typed(column, data_type: T.DataType):
    if isinstance(data_type, T.DateType):
        return F.try_to_date(column, DATE_FORMAT)
    if isinstance(data_type, T.TimestampType):
        return F.try_to_timestamp(column, F.lit(TIMESTAMP_FORMAT))
    return column.try_cast(data_type)


def write_entities(entities: DataFrame, path: str) -> None:
    """Replace the table at ``path``."""
    entities.write.mode("overwrite").parquet(path)
