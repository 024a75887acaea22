"""Reading and writing tables of documents."""

from rivulet.sources.documents import geo_point, read_documents, spark_schema, store_mapping, write_documents

__all__ = ["geo_point", "read_documents", "spark_schema", "store_mapping", "write_documents"]
