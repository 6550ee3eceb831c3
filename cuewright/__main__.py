import sys

from cuewright.cli import main

sys.exit(main())
