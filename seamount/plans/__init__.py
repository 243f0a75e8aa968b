"""The catalogue of registered queries, with DuckDB SQL for each that SQL can express."""
