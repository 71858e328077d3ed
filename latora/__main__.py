import sys

from latora.cli import main

sys.exit(main(sys.argv[1:] or ["recommend", "--explain", "--synthetic"]))
