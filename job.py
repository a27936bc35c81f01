"""spark-submit [--packages ...spark-sql-kafka...] job.py COMMAND --help"""

from tiffinlake.cli import main

if __name__ == "__main__":
    main()
