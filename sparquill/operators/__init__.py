"""Set-at-a-time operators: index build, retrieval, fusion, evaluation, lifecycle."""
