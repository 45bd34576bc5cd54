"""Writers: records to citation formats, and libraries to tables."""
