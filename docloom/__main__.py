import sys

from docloom.cli import main

sys.exit(main())
