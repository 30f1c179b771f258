import sys

from graphstrata.cli import main

sys.exit(main())
